"""Byte-pair encoding and decoding with a tokenizer file, by tree concatenation.

A text is cut at white space and, by the file's own normaliser and splitter,
into pieces. A piece's encoding depends on nothing outside of it. Short pieces
are merged directly and remembered. A long piece has no safe cuts, so it is
encoded as a tree: leaves of LEAF symbols are encoded each for itself, in
parallel tasks where a text has an unsplit run of RUN characters, and joined
two by two. A join re-encodes a window of tokens around the cut and widens it
until its first token is the left side's and its last the right side's.

That is exact: a sequence of tokens is the encoding of its text if and only if
each two neighbours are the encoding of theirs, as the first merge across a
border would also happen between the two tokens alone. Inside both sides and
the window that holds, and where they meet the tokens are the same.

Token ids are packed in little-endian unsigned 32-bit integers. Null and empty
texts have no tokens; each row is encoded for itself, whatever its id.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.frames import spread

LEAF = 1024
RUN = 16_384
WINDOW = 4
REMEMBERED = 200_000
_NONE = 1 << 30
ROWS = 500  # of a batch, handed back together
# The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_white = re.compile(f"[{WHITE}]+")
# Letters up to U+024F that are the same in every version of Unicode, in composed form,
# without those whose lower case is none of them.
_letters = re.findall("[A-Za-zÀ-ÖØ-öø-įı-ɏ]", "".join(map(chr, range(0x250))))
_LATIN = "".join([c for c in _letters if c.lower() in _letters])
_plain = re.compile(f"[!-~{_LATIN}]+")
_plain_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


class Encoder:
    """A byte-pair tokenizer read from the text of its file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        model = told["model"]
        rules = Tokenizer.from_str(spec)
        self._normalise = rules.normalizer.normalize_str if rules.normalizer else str
        self._split = rules.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"])
        self._packed = {t: self.pack([i]) for t, i in self.vocab.items()}
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._special = {text: self.pack([i]) for text, i in special.items()}
        self._any_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self._hints = tuple({text[:2] for text in special})
        n = max([*self.vocab.values(), *special.values()]) + 1
        self.tokens: list[bytes] = [b""] * n
        for text, i in (self.vocab | special).items():
            self.tokens[i] = text.encode()
        known = rules.pre_tokenizer.pre_tokenize_str
        self._bytes = {c: known(c)[0][0] for c in map(chr, range(33, 0x250)) if _plain.fullmatch(c)}
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def symbols(self, piece: str) -> list[str]:
        return [*piece[:-1], piece[-1] + self.suffix]

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of some symbols: the pair of least rank first, then the leftmost."""
        ranks = self.ranks
        if len(symbols) <= 64:
            parts, get = list(symbols), ranks.get
            found = [get(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
            while found:
                least = min(found)
                if least == _NONE:
                    break
                i = found.index(least)
                parts[i] += parts.pop(i + 1)
                del found[i]
                if i < len(found):
                    found[i] = get((parts[i], parts[i + 1]), _NONE)
                if i:
                    found[i - 1] = get((parts[i - 1], parts[i]), _NONE)
            return parts
        n = len(symbols)
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if parts[i] is None or j >= n or parts[j] is None or after[i] != j or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], i))
        return [p for p in parts if p is not None]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The tokens of the text of both; each side is the encoding of its own text."""
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            window = self.merge([s for token in a + b for s in self._symbols_of(token)])
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def _symbols_of(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            return self.symbols(token[: -len(self.suffix)])
        return list(token)

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """The tokens of encoded leaves, joined two by two."""
        while len(leaves) > 1:
            paired = [self.join(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = paired + leaves[len(paired) * 2 :]
        return leaves[0] if leaves else []

    def leaves(self, piece: str, size: int = LEAF) -> list[list[str]]:
        symbols = self.symbols(piece)
        return [symbols[i : i + size] for i in range(0, len(symbols), size)]

    def ids(self, tokens: list[str]) -> bytes:
        packed = self._packed
        return b"".join([packed[t] for t in tokens if t in packed])

    def piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            found = self.ids(self.tree([self.merge(leaf) for leaf in self.leaves(piece)]))
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            if len(piece) < 64:
                self._pieces[piece] = found
        return found

    def split(self, chunk: str) -> list[str | bytes]:
        """Pieces of a text without white space, in byte letters; special tokens as packed ids."""
        if _plain.fullmatch(chunk) and not any(h in chunk for h in self._hints):
            letters = self._bytes
            return ["".join([letters[c] for c in p]) for p in _plain_pieces.findall(chunk.lower())]
        out: list[str | bytes] = []
        for part in self._any_special.split(chunk):
            if part in self._special:
                out.append(self._special[part])
            elif part:
                out += [p for p, _ in self._split(self._normalise(part))]
        return out

    def chunk(self, chunk: str) -> bytes:
        found = b"".join([p if isinstance(p, bytes) else self.piece(p) for p in self.split(chunk)])
        if len(self._chunks) >= REMEMBERED:
            self._chunks.clear()
        if len(chunk) < 64:
            self._chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        known = self._chunks
        return b"".join([known[c] if c in known else self.chunk(c) for c in _white.split(text) if c])

    def decode(self, packed: bytes) -> str:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode()


_encoders: dict[int, Encoder] = {}


def _encoder(spec) -> Encoder:
    """One encoder per worker and broadcast tokenizer file."""
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value)
    return _encoders[key]


def _with_ids(rows: pd.DataFrame, ids: list[bytes], encoder: Encoder, decoded: bool) -> pd.DataFrame:
    return rows.assign(ids=ids, **({"decoded": [encoder.decode(i) for i in ids]} if decoded else {}))


def _encode(spec, decoded: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(spec)
        for batch in batches:
            texts = batch.pop("text")
            for a in range(0, len(batch), ROWS):
                ids = [encoder.encode(t) for t in texts.iloc[a : a + ROWS]]
                yield _with_ids(batch.iloc[a : a + ROWS], ids, encoder, decoded)

    return run


def _parts(spec, leaf: int) -> Callable:
    """Finished ids, and the leaves of long pieces, of texts with long runs, in order."""

    def of(encoder: Encoder, row: int, text: str) -> Iterator[tuple]:
        done: list[bytes] = []
        part = 0
        for chunk in _white.split(text):
            for piece in encoder.split(chunk) if chunk else []:
                if isinstance(piece, bytes) or len(piece) <= leaf:
                    done.append(piece if isinstance(piece, bytes) else encoder.piece(piece))
                    continue
                yield row, part, 0, b"".join(done), None
                for k, symbols in enumerate(encoder.leaves(piece, leaf)):
                    yield row, part + 1, k, None, "\n".join(symbols)
                done, part = [], part + 2
        yield row, part, 0, b"".join(done), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(spec)
        for batch in batches:
            for row, text in zip(batch["_row"], batch["text"], strict=True):
                parts = list(of(encoder, row, text))
                for a in range(0, len(parts), 4096):
                    yield pd.DataFrame(parts[a : a + 4096], columns=["_row", "part", "leaf", "ids", "symbols"])

    return run


def _merge_leaves(spec) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(spec)
        for batch in batches:
            tokens = [s if s is None else "\n".join(encoder.merge(s.split("\n"))) for s in batch.pop("symbols")]
            yield batch.assign(tokens=tokens)

    return run


def _assemble(spec, decoded: bool) -> Callable:
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        encoder = _encoder(spec)
        batch = batch.sort_values(["part", "leaf"])
        out = []
        for _, part in batch.groupby("part", sort=True):
            if part["ids"].iloc[0] is not None:
                out.append(part["ids"].iloc[0])
            else:
                out.append(encoder.ids(encoder.tree([t.split("\n") for t in part["tokens"]])))
        return _with_ids(batch[["_row"]].iloc[:1], [b"".join(out)], encoder, decoded)

    return run


def unsplit(run: int = RUN, text: str = "text") -> Column:
    """Whether a text holds ``run`` characters without white space.

    Such a run covers an aligned block of half its bytes. Blocks are looked at only
    up to their first white space, so the slow exact search is left to texts that have
    a block without any."""
    size = max(run // 2, 1)
    raw = F.col(text).cast("binary")
    block = lambda k: F.substring(raw, (k * size + 1).cast("int"), F.lit(size)).cast("string")
    blocks = F.sequence(F.lit(0), F.floor(F.octet_length(text) / size).cast("int"))
    whole = lambda k: ((k + 1) * size <= F.octet_length(text)) & ~block(k).rlike("[\\t\\n\\r ]")
    exact = F.col(text).rlike(f"(?<![^{WHITE}])[^{WHITE}]{{{run}}}")
    return (F.octet_length(text) >= run) & F.exists(blocks, whole) & exact


def encode(
    docs: DataFrame, spec: str, *columns: str, decoded: bool = False, run: int = RUN, leaf: int = LEAF
) -> DataFrame:
    """``columns`` (by default doc_id) and ``ids`` of every document, for a
    tokenizer file's text ``spec``; if asked for also ``decoded``, the ids decoded
    in the same task."""
    columns = columns or ("doc_id",)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    docs = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    result = "ids binary, decoded string" if decoded else "ids binary"
    plain = spread(docs.where(~unsplit(run))).mapInPandas(_encode(shared, decoded), f"{kept}, {result}")

    long = materialise(docs.where(unsplit(run)).withColumn("_row", F.monotonically_increasing_id()), "unsplit")
    parts = long.select("_row", "text").mapInPandas(_parts(shared, leaf), "_row bigint, part bigint, leaf bigint, ids binary, symbols string")
    leaves = parts.repartition("_row", "part", "leaf").mapInPandas(
        _merge_leaves(shared), "_row bigint, part bigint, leaf bigint, ids binary, tokens string"
    )
    whole = leaves.groupBy("_row").applyInPandas(_assemble(shared, decoded), f"_row bigint, {result}")
    return plain.unionByName(long.drop("text").join(whole, "_row").drop("_row"))


def decode(tokens: DataFrame, spec: str) -> DataFrame:
    """The rows with ``text``, the decoded ids: tokens as the vocabulary names
    them, special ones too, with a space between."""
    shared = tokens.sparkSession.sparkContext.broadcast(spec)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.iloc[a : a + ROWS]
                yield part.assign(text=[encoder.decode(i) for i in part["ids"]])

    return tokens.mapInPandas(run, f"{schema}, text string")


def n_tokens(ids: str = "ids") -> Column:
    return (F.length(ids) / 4).cast("bigint")


def digest(docs: DataFrame, spec: str, *columns: str) -> DataFrame:
    """Number and hash of the ids, and hash of the decoded text, of each document."""
    both = encode(docs, spec, *columns, decoded=True)
    return both.select(
        *(columns or ["doc_id"]),
        n_tokens().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
