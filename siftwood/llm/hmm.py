"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Texts are words, A-Z folded, then an end mark. One pass packs them in blocks,
each with its own list of words, told apart by 64-bit hashes. One shuffle by word
counts them over all blocks, and blocks get back the counts of words they share
with others. Words that make up at least
1 in FREQUENT of all tokens, so at most FREQUENT, have emission probabilities of
their own; the others share RARE classes by their last letters, and within a
class go by (count + 1/2) / (all + (words + 1) / 2), the last 1/2 for any unknown
word. Model and expected counts are thus bounded, whatever the corpus.

A round of training is one job: tasks add up expected counts of their blocks and
send them in SLICES, which are summed by slice. The start is sticky states with
perturbed word frequencies, the same in every run. Scores are exact log10
likelihoods from the scaled forward recursion. Null and empty texts are an end
mark alone; rows of one id are scored each for itself; a null id trains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.chains import Chains
from siftwood.llm.frames import small_batches, spread
from siftwood.llm.words import Texts, as_bytes

STATES = 6
ROUNDS = 4
FREQUENT = 16_384
RARE = 1024
END = 0  # class of the end mark; frequent words follow, then rare classes
N_CLASSES = 1 + FREQUENT + RARE
SLICES = 64
BLOCK_BYTES = 16 << 20
PART_TOKENS = 600_000
STICKY = 0.98
PRIOR = 200.0  # tokens' worth of overall frequencies in each state's emissions


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed blocks of about BLOCK_BYTES of text, gathered over small batches."""
    rows: list[tuple[bytes, bool, int | None]] = []
    size = 0
    for batch in batches:
        for text, held, doc_id in zip(batch["text"], batch["held"], batch["doc_id"], strict=True):
            text = as_bytes(text)
            if rows and size + len(text) > BLOCK_BYTES:
                yield _block(rows)
                rows, size = [], 0
            rows.append((text, held, None if pd.isna(doc_id) else int(doc_id)))
            size += len(text)
    if rows:
        yield _block(rows)


def _block(rows: list[tuple[bytes, bool, int | None]]) -> pd.DataFrame:
    # By length, so that the long texts, which need many steps, share their parts.
    rows.sort(key=lambda row: len(row[0]))
    held = np.array([row[1] for row in rows], bool)
    t = Texts([row[0] for row in rows])
    starts, ends = t.word_spans()
    hashes = t.hashes(starts, ends)
    lengths = np.bincount(t.owners(starts), minlength=t.n).astype(np.int32)
    ids, words = pd.factorize(hashes)
    # Codes are given as words first occur.
    at = np.flatnonzero(np.diff(np.maximum.accumulate(ids), prepend=-1))
    found = np.bincount(ids, minlength=len(words))
    # Frequent words first: their small numbers pack well.
    order = np.argsort(-found, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    ids, words = rank[ids], words[order]
    endings = np.empty(len(order), np.int64)
    endings[ids[at]] = (t.hashes(np.maximum(starts[at], ends[at] - 3), ends[at]) % np.uint64(RARE)).astype(np.int64)
    trained = ids[np.repeat(~held, lengths)]
    return pd.DataFrame(
        {
            "doc_ids": [[row[2] for row in rows]],
            "held": [held],
            "lengths": [lengths],
            "ids": [zstandard.ZstdCompressor(level=1).compress(ids.tobytes())],
            "words": [words.view(np.int64)],
            "rare": [endings + 1 + FREQUENT],
            "counts": [np.bincount(trained, minlength=len(words))],
        }
    )


def pack(docs: DataFrame, held: Column) -> DataFrame:
    """The texts in blocks of about BLOCK_BYTES, written once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    schema = (
        "doc_ids array<bigint>, held array<boolean>, lengths array<int>, ids binary, words array<bigint>, "
        "rare array<int>, counts array<int>"
    )
    packed = spread(rows).mapInPandas(_blocks, schema)
    return materialise(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


@dataclass(frozen=True)
class Counts:
    """Training counts: all tokens, distinct tokens; the frequent words in hash
    order and their classes; by class tokens and words."""

    tokens: int
    distinct: int
    frequent: np.ndarray
    classes: np.ndarray
    by_class: np.ndarray
    words_of: np.ndarray


def count_words(blocks: DataFrame) -> tuple[DataFrame, Counts]:
    """(word, rare, block, pos, n, c, first) of the words of all blocks, n their count in
    the block and c in all; first marks one row per word. And the totals."""
    zipped = F.arrays_zip("words", "rare", "counts")
    rows = blocks.select("block", F.posexplode(zipped).alias("pos", "x")).select(
        "block", "pos", F.col("x.words").alias("word"), F.col("x.rare").alias("rare"), F.col("x.counts").alias("n")
    )
    # A word has at most one row per block.
    of_word = W.partitionBy("word")
    rows = rows.withColumn("c", F.sum("n").over(of_word))
    first = F.col("block") == F.min("block").over(of_word)
    words = materialise(rows.withColumn("first", first), "words")
    trained = words.where("first AND c > 0")
    told = trained.agg(F.sum("c"), F.count("*")).first()
    n_ends = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    tokens, distinct = (told[0] or 0) + n_ends, told[1] + (n_ends > 0)
    # By the bound at most FREQUENT words.
    listed = trained.where(F.col("c") * FREQUENT >= tokens).select("word", "c").collect()
    listed.sort(key=lambda r: (-r["c"], r["word"]))
    frequent = np.array([r["word"] for r in listed], np.int64)
    order = np.argsort(frequent)
    by_class, words_of = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
    by_class[END] = n_ends
    by_class[1 : 1 + len(listed)] = [r["c"] for r in listed]
    words_of[1 : 1 + len(listed)] = 1
    others = trained.where(F.col("c") * FREQUENT < tokens).groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    for r in others.collect():
        by_class[r["rare"]], words_of[r["rare"]] = r["c"], r["n"]
    return words, Counts(tokens, distinct, frequent[order], order + 1, by_class, words_of)


def with_counts(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks with the counts of the words that other blocks have too (pos, c)."""
    shared = words.where("c <> n").groupBy("block").agg(F.collect_list(F.struct("pos", "c")).alias("w"))
    lists = shared.select("block", F.col("w.pos").alias("pos"), F.col("w.c").alias("c"))
    return materialise(blocks.join(lists, "block", "left"), "counted")


@dataclass(frozen=True)
class Model:
    first: np.ndarray
    moves: np.ndarray
    emission: np.ndarray  # classes by states


def frequencies(counts: Counts) -> np.ndarray:
    """Every class's share of training tokens, none zero."""
    share = counts.by_class + 0.5
    return share / share.sum()


def start(counts: Counts) -> Model:
    noise = np.random.default_rng(11).normal(0, 1, (N_CLASSES, STATES))
    emission = frequencies(counts)[:, None] * np.exp(noise)
    moves = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(moves, STICKY)
    return Model(np.full(STATES, 1 / STATES), moves, emission / emission.sum(0))


class Block:
    """One packed block, its end marks added."""

    def __init__(self, row, counts: Counts):
        n = len(row["lengths"])
        self.lengths = np.asarray(row["lengths"], np.int64) + 1
        words = np.asarray(row["words"], np.int64)
        c = np.asarray(row["counts"], np.float64)
        if row["pos"] is not None:
            c[np.asarray(row["pos"], np.int64)] = np.asarray(row["c"], np.float64)
        classes = np.asarray(row["rare"], np.int64)
        if len(counts.frequent) and len(words):
            at = np.minimum(np.searchsorted(counts.frequent, words), len(counts.frequent) - 1)
            classes = np.where(counts.frequent[at] == words, counts.classes[at], classes)
        rare = classes > FREQUENT
        within = np.ones(len(c) + 1)
        within[:-1][rare] = ((c + 0.5) / (counts.by_class[classes] + 0.5 * (counts.words_of[classes] + 1)))[rare]
        self.within, self.classes = within, np.r_[classes, END]
        self.c = np.r_[c, counts.by_class[END]]
        self.ids = np.full(int(self.lengths.sum()), len(c), np.int32)
        self.ends = np.cumsum(self.lengths)
        mask = np.ones(len(self.ids), bool)
        mask[self.ends - 1] = False
        self.ids[mask] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), np.int32)
        self.held = np.asarray(row["held"], bool)
        self.starts = self.ends - self.lengths

    def emission(self, model: Model) -> np.ndarray:
        """States by the block's words."""
        return np.take(np.ascontiguousarray(model.emission.T), self.classes, 1) * self.within

    def parts(self) -> Iterator[slice]:
        """Runs of texts of about PART_TOKENS; a longer text stands alone."""
        at = 0
        while at < len(self.ends):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + PART_TOKENS, "right")))
            yield slice(at, to)
            at = to


def _expect(counts, model) -> Callable:
    """Expected counts of a task's training texts, in slices of one flat array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, m = counts.value, model.value
        # Single precision is enough to add up what is expected; sums and scores are doubles.
        first, moves = m.first.astype(np.float32), m.moves.astype(np.float32)
        total = np.zeros(STATES + STATES * STATES + N_CLASSES * STATES)
        seen = total[STATES + STATES * STATES :].reshape(N_CLASSES, STATES)
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row, told)
                emission = block.emission(m).astype(np.float32)
                for part in block.parts():
                    train, lengths = ~block.held[part], block.lengths[part]
                    if not train.any():
                        continue
                    ids = block.ids[block.starts[part][0] : block.ends[part][-1]][np.repeat(train, lengths)]
                    chains = Chains(lengths[train])
                    laid = chains.laid(ids)
                    e = np.take(emission, laid, 1)
                    alpha, scale = chains.forward_by_state(e.copy(), moves, first)
                    gamma, moved = chains.marginals_by_state(alpha, e, moves, scale)
                    classes = block.classes[laid]
                    total[:STATES] += gamma[:, : chains.active[0]].sum(1)
                    total[STATES:][: STATES * STATES] += moved.ravel()
                    for s in range(STATES):
                        seen[:, s] += np.bincount(classes, gamma[s], N_CLASSES)
        parts = np.array_split(total, SLICES)
        yield pd.DataFrame({"slice": range(SLICES), "sums": [p.tobytes() for p in parts]})

    return run


def _add(batch: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x) for x in batch["sums"])
    return pd.DataFrame({"slice": batch["slice"].iloc[:1], "sums": [total.tobytes()]})


def baum_welch(blocks: DataFrame, counts: Counts, model: Model) -> Model:
    """One round of training."""
    context = blocks.sparkSession.sparkContext
    schema = "slice int, sums binary"
    parts = blocks.mapInPandas(_expect(context.broadcast(counts), context.broadcast(model)), schema)
    rows = parts.groupBy("slice").applyInPandas(_add, schema).collect()
    if not rows:
        return model
    total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows)])
    first, moves, seen = np.split(total, [STATES, STATES + STATES * STATES])
    first, moves = first + 0.1, moves.reshape(STATES, STATES) + 0.1
    seen = seen.reshape(N_CLASSES, STATES) + PRIOR * frequencies(counts)[:, None]
    return Model(first / first.sum(), moves / moves.sum(1, keepdims=True), seen / seen.sum(0))


def train(blocks: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    model = start(counts)
    for _ in range(rounds):
        model = baum_welch(blocks, counts, model)
    return model


def _score(counts, model) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, m = counts.value, model.value
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row, told)
                emission = block.emission(m)
                base = np.log10((block.c + 0.5) / (told.tokens + 0.5 * (told.distinct + 1)))
                for part in block.parts():
                    lengths = block.lengths[part]
                    ids = block.ids[block.starts[part][0] : block.ends[part][-1]]
                    starts = block.starts[part] - block.starts[part][0]
                    chains = Chains(lengths)
                    _, scale = chains.forward_by_state(np.take(emission, chains.laid(ids), 1), m.moves, m.first)
                    doc_ids = [None if pd.isna(i) else int(i) for i in row["doc_ids"][part]]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(doc_ids, "Int64"),
                            "held_out": block.held[part],
                            "n_tokens": lengths,
                            "n_known": np.add.reduceat((block.c > 0)[ids].astype(np.int64), starts),
                            "train_tokens": told.tokens,
                            "base_score": np.add.reduceat(base[ids], starts),
                            "score": chains.sums(np.log10(scale)),
                        }
                    )

    return run


def score(blocks: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """Per document the unigram score and the model's log10 likelihood."""
    context = blocks.sparkSession.sparkContext
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    return blocks.mapInPandas(_score(context.broadcast(counts), context.broadcast(model)), schema)


def score_documents(docs: DataFrame, held: Column, rounds: int = ROUNDS) -> DataFrame:
    small_batches(docs.sparkSession)  # of texts, and then of packed blocks
    packed = pack(docs, held)
    words, counts = count_words(packed)
    blocks = with_counts(packed, words)
    return score(blocks, counts, train(blocks, counts, rounds))
