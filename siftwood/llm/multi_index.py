"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised on their own, so few centroids name
many cells. A query walks pairs of centroids by the sum of its distances to
both, with a heap, until the cells passed hold enough entries; these are
reranked by exact distance.

Codebooks, and the share of entries to pass, are fitted on at most SAMPLE_ROWS
vectors (or SAMPLE_BYTES) chosen by a hash of their id: the share is the least
of SHARES at which sample queries find GOAL of their true neighbours. Every
vector is indexed. Cells are dealt to blocks of equal size, a cell larger than
a block is split by a hash of the id, and a task holds one block of entries and
one of queries; a block is copied only as often as the queries that probe it fill
tasks. Vectors null, zero, holding null or non-finite components, of a
width other than the commonest, or without an id take no part. Of several query
rows of one id the least vector is asked; rows of the query's own id are no
candidates. Equal distances go to smaller ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import broadcast_if_small, materialise
from siftwood.llm.frames import SMALL_ROWS

K = 10
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 16 << 20
SAMPLE_QUERIES = 100
SHARES = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.85, 1.0]
GOAL = 0.95
LEAST_ENTRIES = 2_000
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _squares(vectors[:, :cut], self.left), _squares(vectors[:, cut:], self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(1) * len(self.right) + b.argmin(1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def _k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of rows; an empty one takes the row farthest from its own."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(5).permutation(len(centres))[:k]]
    for _ in range(rounds):
        d = _squares(x, centres)
        own, far = d.argmin(1), d.min(1)
        for j in range(len(centres)):
            inside = own == j
            if inside.any():
                centres[j] = x[inside].mean(0)
            else:
                centres[j] = x[far.argmax()]
                far[far.argmax()] = 0
    return centres


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells by the sum of their centroids' distances until they hold ``enough`` entries."""
    rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[rows].tolist(), b[columns].tolist()
    rows, columns, width = rows.tolist(), columns.tolist(), len(y)
    heap = [(x[0] + y[0], 0, 0)]
    cells, held = [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * width + columns[j]
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        # Each pair has one parent: right along its row, down from the first column.
        if j + 1 < width:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def fit(sample: np.ndarray, n: int) -> tuple[Codebooks, float]:
    """Codebooks for ``n`` vectors and the share of entries a query has to pass."""
    k = int(2 ** np.clip(np.round(np.log2(max(n, 1) ** 0.5 / 4)), 3, 8))
    cut = (sample.shape[1] + 1) // 2
    books = Codebooks(_k_means(sample[:, :cut], k), _k_means(sample[:, cut:], k))
    cells = books.cells(sample)
    counts = np.bincount(cells, minlength=len(books.left) * len(books.right))
    asked = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    d = _squares(sample[asked], sample)
    d[np.arange(len(asked)), asked] = np.inf
    nearest = np.argsort(d, 1, kind="stable")[:, :K]
    a, b = books.distances(sample[asked])
    for share in SHARES:
        hits = [np.isin(cells[nearest[i]], walk(a[i], b[i], counts, share * len(sample))).mean() for i in range(len(asked))]
        if np.mean(hits) >= GOAL:
            return books, share
    return books, 1.0


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vec, in doubles, of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vec.alias("vec")).where(F.col("vec_id").isNotNull() & (F.size("vec") > 0))
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    rows = rows.where(F.forall("vec", finite)).where(F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.where(F.size("vec") == (width["w"] if width else 0))


def _assign(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=shared.value.cells(_matrix(batch["vec"])))

    return run


def _probe(shared, counts, first_block, n_blocks, enough: float) -> Callable:
    """Per query and block its vector and the cells to look at there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = shared.value.distances(_matrix(batch["vec"]))
            out = []
            for i, (query, vec) in enumerate(zip(batch["vec_id"], batch["vec"], strict=True)):
                by_block: dict[int, list[int]] = {}
                for cell in walk(a[i], b[i], counts.value, enough):
                    for k in range(n_blocks.value[cell]):
                        by_block.setdefault(int(first_block.value[cell]) + k, []).append(cell)
                out += [(block, query, vec, cells) for block, cells in by_block.items()]
            yield pd.DataFrame(out, columns=["block", "query_id", "vec", "cells"])

    return run


def _rerank(key, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The K nearest entries in its cells of each query, by differences in double precision."""
    out = []
    if len(entries) and len(queries):
        entries = entries.sort_values("vec_id")
        ids, points = entries["vec_id"].to_numpy(), _matrix(entries["vec"])
        known, cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        asked = _matrix(queries["vec"])
        # Rounding of the fast distances; what lies within it is measured exactly.
        slack = 1e-9 * (1 + (points * points).sum(1).max() + (asked * asked).sum(1).max())
        for i, (query, cells) in enumerate(zip(queries["query_id"], queries["cells"], strict=True)):
            probed = np.zeros(len(known), bool)
            probed[np.searchsorted(known, cells)[np.isin(cells, known)]] = True
            at = np.flatnonzero(probed[cell] & (ids != query))
            if not len(at):
                continue
            rough = _squares(asked[i : i + 1], points[at])[0]
            if len(at) > K:
                at = at[rough <= np.partition(rough, K - 1)[K - 1] + slack]
            score = np.sqrt(np.square(points[at] - asked[i]).sum(1))
            best = np.lexsort((ids[at], score))[:K]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def search(vectors: DataFrame, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of the neighbours found for each query,
    a row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors), "vectors")
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width")).first()
    n, width = told["n"], told["width"]
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    spots = 1 << 30
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(spots)) < int(spots * min(1.0, most / max(n, 1)))
    sample = rows.where(chosen).orderBy("vec_id", "vec").limit(2 * most).select("vec").toPandas()["vec"]
    if not len(sample):
        sample = rows.limit(most).select("vec").toPandas()["vec"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    books, share = fit(_matrix(sample), n)
    shared = spark.sparkContext.broadcast(books)
    index = materialise(rows.mapInPandas(_assign(shared), "vec_id bigint, vec array<double>, cell int"), "cells")

    # At most len(left) * len(right) rows, 65,536.
    counts = np.zeros(len(books.left) * len(books.right), np.int64)
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    size = int(np.clip(n // 16, 512, 8192))
    n_blocks = np.maximum(-(-counts // size), 1)
    small = n_blocks == 1
    packed = np.cumsum(np.where(small, counts, 0)) // size
    first_block = np.where(small, packed, packed.max() + 1 + np.cumsum(np.where(small, 0, n_blocks)) - n_blocks)
    placed = [spark.sparkContext.broadcast(x) for x in (counts, first_block, n_blocks)]

    queries = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    probe = _probe(shared, *placed, max(share * n, LEAST_ENTRIES))
    asked = queries.mapInPandas(probe, "block bigint, query_id bigint, vec array<double>, cells array<int>")
    asked = materialise(asked, "asked")
    # Only blocks that are probed are sent, once for every QUERY_BLOCK of their queries.
    parts = asked.groupBy("block").agg((F.floor((F.count("*") - 1) / QUERY_BLOCK) + 1).alias("parts"))
    parts = broadcast_if_small(materialise(parts, "parts"), SMALL_ROWS)
    asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("parts"))).drop("parts")

    cells = spark.createDataFrame(
        [(int(c), int(first_block[c]), int(n_blocks[c])) for c in np.flatnonzero(counts)], "cell int, first long, blocks long"
    )
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).alias("block")
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    entries = index.join(F.broadcast(cells), "cell").select(block, "vec_id", "vec", "cell")
    entries = entries.join(parts, "block").select("block", "vec_id", "vec", "cell", every_part)
    found = (
        entries.groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInPandas(_rerank, "query_id bigint, vec_id bigint, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
