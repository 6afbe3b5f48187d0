"""Toxic spans by a linear-chain conditional random field, and document scores.

Words and their beginnings are features. How many toxic and clean labelled
documents hold each gives a lexicon of cautious odds, so an entry is judged by
its own documents, however few of all toxic ones its language has. A token's code
tells the level of the odds of its word, and of its best beginning. Tokens of toxic
documents at a high level, or at the document's highest, are labelled toxic, all
others clean, and the field (a weight per code and state, and one per pair of
states) is fitted to those labels. Forward and backward passes give every token's marginal
probability; a document's score is a logistic function of the largest and the
summed marginals, and its spans are runs of tokens more likely toxic than not.

The model is fitted on at most about SAMPLE_DOCS labelled documents, chosen by a
hash of the id, of which TRAIN_DOCS of each class give tokens to the field; all
texts are scored whole. Rows in ``held`` teach nothing. Labels null or absent
take no part; of several labels of an id the greatest counts, and equal texts
count once. Without labels of both classes every score is the toxic share.
Null and empty texts have no tokens and score as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.chains import Chains
from siftwood.llm.frames import spread
from siftwood.llm.words import Texts, as_bytes, mix, not_alphanumeric, slices

SAMPLE_DOCS = 20_000
TRAIN_DOCS = 600
BEGINNINGS = [4, 5, 6, 7]
LEAST_DOCS = 3
N_LEVELS = 4
N_CODES = (N_LEVELS + 1) ** 2
SEGMENT = 256
SLICE = 8 << 20
FOLDS = 3


@dataclass(frozen=True)
class Settings:
    """Cautious log odds from which an entry's level is 1 to N_LEVELS; the level from
    which a toxic document's tokens are taught as toxic; and by how much the square
    root of a count is moved against the entry."""

    levels: tuple[float, ...]
    labelled: int
    caution: float


# What ``cross_validate`` ranks first of 11 settings on the labelled documents that
# are not held out (2,897 texts of sf0.1; losses from 0.259 to 0.559).
SETTINGS = Settings((1.0, 1.5, 2.0, 2.5), 3, 0.85)


def token_features(t: Texts) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of all tokens; per kind of feature the tokens that have it and its hashes."""
    starts, ends = t.word_spans(not_alphanumeric)
    out = [(np.arange(len(starts)), t.hashes(starts, ends))]
    for k, n in enumerate(BEGINNINGS):
        at = np.flatnonzero(ends - starts > n)
        out.append((at, mix(t.hashes(starts[at], starts[at] + n) ^ np.uint64(k + 1))))
    return starts, ends, out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many toxic and clean documents of a slice each feature is."""
    for batch in batches:
        texts, toxic = [as_bytes(x) for x in batch["text"]], batch["toxic"].to_numpy()
        for a, b in slices(texts, SLICE):
            t = Texts(texts[a:b])
            starts, _, features = token_features(t)
            owners = t.owners(starts)
            own = mix(np.arange(1, t.n + 1, dtype=np.uint64))
            keys = np.concatenate([h for _, h in features])
            docs = np.concatenate([owners[at] for at, _ in features])
            _, once = np.unique(keys ^ own[docs], return_index=True)
            keys, back = np.unique(keys[once], return_inverse=True)
            n_toxic = np.bincount(back, toxic[a:b][docs[once]], len(keys)).astype(np.int64)
            n_all = np.bincount(back, minlength=len(keys))
            yield pd.DataFrame({"feature": keys.view(np.int64), "toxic": n_toxic, "clean": n_all - n_toxic})


@dataclass(frozen=True)
class Lexicon:
    features: np.ndarray
    levels: np.ndarray

    def codes(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and codes of all tokens."""
        starts, ends, features = token_features(t)
        table = np.zeros(1 << 20, bool)
        table[self.features & np.uint64(0xFFFFF)] = True
        word, beginning = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k, (at, hashes) in enumerate(features):
            maybe = np.flatnonzero(table[hashes & np.uint64(0xFFFFF)])
            if not len(maybe):
                continue
            i = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
            level = np.where(self.features[i] == hashes[maybe], self.levels[i], 0)
            target = word if k == 0 else beginning
            target[at[maybe]] = np.maximum(target[at[maybe]], level)
        return starts, ends, word * (N_LEVELS + 1) + beginning


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, settings: Settings = SETTINGS) -> Lexicon:
    """All entries that pass the first level; the sample bounds how many there are."""
    counts = sample.mapInPandas(_count, "feature bigint, toxic bigint, clean bigint")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least_toxic, most_clean = F.sqrt(F.col("toxic") + 0.5) - settings.caution, F.sqrt(F.col("clean") + 0.5) + settings.caution
    odds = 2 * (F.log(least_toxic) - F.log(most_clean)) - F.log(F.lit((n_toxic + 1) / (n_clean + 1)))
    best = counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= settings.levels[0])
    rows = best.select("feature", "odds").collect()
    features = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    levels = np.searchsorted(settings.levels, np.array([r["odds"] for r in rows]), "right")
    order = np.argsort(features)
    return Lexicon(features[order], levels[order])


@dataclass(frozen=True)
class Field:
    """Weights of the field: codes by states, moves between states."""

    codes: np.ndarray
    moves: np.ndarray

    def passes(self, chains: Chains, laid: np.ndarray) -> tuple[np.ndarray, ...]:
        emission, moves = np.exp(self.codes)[laid], np.exp(self.moves)
        alpha, scale = chains.forward(emission, moves, np.ones(2))
        beta = chains.backward(emission, moves, scale)
        return alpha, beta, emission, moves, scale


def fit_field(codes: list[np.ndarray], toxic: np.ndarray, rounds: int = 60, labelled: int = SETTINGS.labelled) -> Field:
    """Weights that make the labels of tokens likely, by adaptive gradient steps."""
    parts, labels = [], []
    for own, is_toxic in zip(codes, toxic, strict=True):
        level = np.maximum(own // (N_LEVELS + 1), own % (N_LEVELS + 1))
        bar = min(labelled, max(level.max(initial=0), 1))
        marks = (level >= bar).astype(np.int64) * int(is_toxic)
        for i in range(0, len(own), SEGMENT):
            parts.append(own[i : i + SEGMENT])
            labels.append(marks[i : i + SEGMENT])
    field = Field(np.zeros((N_CODES, 2)), np.zeros((2, 2)))
    if not parts:
        return field
    lengths = np.array([len(p) for p in parts])
    chains = Chains(lengths)
    items, marks = np.concatenate(parts), np.concatenate(labels)
    laid = chains.laid(items)
    n = len(items)
    told = np.zeros((N_CODES, 2))
    np.add.at(told, (items, marks), 1)
    told_moves = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    np.add.at(told_moves, (marks[at], marks[at + 1]), 1)
    speed = [np.full((N_CODES, 2), 1e-12), np.full((2, 2), 1e-12)]
    for _ in range(rounds):
        alpha, beta, emission, moves, scale = field.passes(chains, laid)
        expected_moves = chains.moved(alpha, beta, emission, moves, scale)
        p = alpha * beta
        expected = np.stack([np.bincount(laid, p[:, s], N_CODES) for s in (0, 1)], 1)
        steps = [(told - expected) / n - 1e-6 * field.codes, (told_moves - expected_moves) / n - 1e-6 * field.moves]
        speed = [v + g * g for v, g in zip(speed, steps, strict=True)]
        field = Field(*[w + 0.5 * g / np.sqrt(v) for w, g, v in zip((field.codes, field.moves), steps, speed, strict=True)])
    return field


def tag(texts: list[bytes], lexicon: Lexicon, field: Field) -> tuple[np.ndarray, list[str]]:
    """Per text the largest and the summed marginals, and its toxic spans as
    start:end in code points, comma-joined."""
    t = Texts(texts)
    starts, ends, codes = lexicon.codes(t)
    owners = t.owners(starts)
    lengths = np.bincount(owners, minlength=t.n)
    has = np.flatnonzero(lengths)
    told, spans = np.zeros((t.n, 2)), [""] * t.n
    if not len(has):
        return told, spans
    chains = Chains(lengths[has])
    alpha, beta, *_ = field.passes(chains, chains.laid(codes))
    p = (alpha[:, 1] * beta[:, 1])[chains.place]
    told[has, 0], told[has, 1] = np.maximum.reduceat(p, chains.starts), np.add.reduceat(p, chains.starts)
    likely = np.flatnonzero(p > 0.5)
    if len(likely):
        before = t.characters()
        new = np.r_[True, (np.diff(likely) > 1) | (np.diff(owners[likely]) > 0)]
        first, last = likely[new], likely[np.r_[new[1:], True]]
        found: dict[int, list[str]] = {}
        for i, j in zip(first, last, strict=True):
            base = before[t.starts[owners[i]]]
            found.setdefault(owners[i], []).append(f"{before[starts[i]] - base}:{before[ends[j]] - base}")
        for i, own in found.items():
            spans[i] = ",".join(own)
    return told, spans


def _columns(told: np.ndarray) -> np.ndarray:
    top = np.clip(told[:, 0], 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(told)), np.log(top / (1 - top)), np.log1p(told[:, 1])], 1)


def fit_scores(told: np.ndarray, toxic: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps with a small penalty."""
    x, w = _columns(told), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (toxic - p) - 0.5 * w), -4, 4)
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    field: Field
    weights: np.ndarray

    def scores(self, told: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_columns(told) @ self.weights, -40, 40)))


def _sample_codes(lexicon) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [lexicon.value.codes(Texts([as_bytes(x)]))[2].astype(np.uint8).tobytes() for x in batch["text"]]
            yield batch[["sig", "toxic"]].assign(codes=own)

    return run


def _sample_marginals(lexicon, field) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [as_bytes(x) for x in batch["text"]]
            for a, b in slices(texts, SLICE):
                told, _ = tag(texts[a:b], lexicon.value, field.value)
                yield batch[["sig", "toxic"]].iloc[a:b].assign(top=told[:, 0], total=told[:, 1])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, held: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """text, toxic and sig, a hash of the text, of labelled documents that aren't held out."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > sample_docs:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_docs / n))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # About sample_docs labels of two numbers: a bounded broadcast.
    sample = texts.join(F.broadcast(labels), "doc_id").select("text", "toxic", F.xxhash64("text").alias("sig"))
    return materialise(sample.dropDuplicates(["sig"]), "sample")


def train(docs: DataFrame, labels: DataFrame, held: Column, sample_docs: int = SAMPLE_DOCS, settings: Settings = SETTINGS) -> Model:
    return fit(labelled_sample(docs, labels, held, sample_docs), settings)


def fit(sample: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Lexicon, field and score weights from a ``labelled_sample``."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    context = sample.sparkSession.sparkContext
    share = np.array([np.log((n_toxic + 0.5) / (n_clean + 0.5)), 0.0, 0.0])
    if not n_toxic or not n_clean:
        nothing = Lexicon(np.empty(0, np.uint64), np.empty(0, np.int64))
        return Model(nothing, Field(np.zeros((N_CODES, 2)), np.zeros((2, 2))), share)
    lexicon = learn_lexicon(sample, n_toxic, n_clean, settings)
    shared = context.broadcast(lexicon)
    chosen = [sample.where(F.col("toxic") == 1).orderBy("sig").limit(TRAIN_DOCS), sample.where(F.col("toxic") != 1).orderBy("sig").limit(TRAIN_DOCS)]
    rows = chosen[0].unionAll(chosen[1]).mapInPandas(_sample_codes(shared), "sig bigint, toxic int, codes binary").collect()
    rows.sort(key=lambda r: (r["toxic"], r["sig"]))
    field = fit_field([np.frombuffer(r["codes"], np.uint8).astype(np.int64) for r in rows], np.array([r["toxic"] == 1 for r in rows]), labelled=settings.labelled)
    told = sample.mapInPandas(_sample_marginals(shared, context.broadcast(field)), "sig bigint, toxic int, top double, total double")
    told = told.orderBy("sig").toPandas()
    weights = fit_scores(told[["top", "total"]].to_numpy(), (told["toxic"] == 1).to_numpy().astype(float))
    return Model(lexicon, field, weights)


def cross_validate(sample: DataFrame, grid: list[Settings]) -> list[tuple[float, Settings]]:
    """Settings with the log loss of their scores on the folds of a labelled sample that
    each fit left out, the lowest first. It is the mean of both classes' means, since
    toxic documents are few. Nothing but the sample is read."""
    fold = F.pmod(F.xxhash64("sig", F.lit(9)), F.lit(FOLDS))
    out = []
    for settings in grid:
        sums: dict[bool, list[float]] = {}
        for k in range(FOLDS):
            model = fit(sample.where(fold != k), settings)
            left = sample.where(fold == k).select(F.col("sig").alias("doc_id"), "text", "toxic")
            scored = score(left, model).join(left.select("doc_id", (F.col("toxic") == 1).alias("is_toxic")), "doc_id")
            right = F.when(F.col("is_toxic"), F.col("score")).otherwise(1 - F.col("score"))
            loss = F.sum(-F.log(F.greatest(right, F.lit(1e-9)))).alias("loss")
            for row in scored.groupBy("is_toxic").agg(loss, F.count("*").alias("n")).collect():
                kept = sums.setdefault(row["is_toxic"], [0.0, 0.0])
                kept[0], kept[1] = kept[0] + row["loss"], kept[1] + row["n"]
        out.append((float(np.mean([loss / n for loss, n in sums.values()])) if sums else 0.0, settings))
    return sorted(out, key=lambda x: x[0])


def _score(model) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            texts = [as_bytes(x) for x in batch.pop("text")]
            for a, b in slices(texts, SLICE):
                told, spans = tag(texts[a:b], m.lexicon, m.field)
                yield batch.iloc[a:b].assign(score=m.scores(told), spans=spans)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInPandas(_score(shared), "doc_id bigint, score double, spans string")
