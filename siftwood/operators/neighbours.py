"""Nearest neighbours by dot product of unit vectors.

Exact search multiplies blocks: a task turns each Arrow batch of documents
into a matrix, multiplies it with the query matrix and keeps k rows per query,
so at most k x queries x tasks rows are shuffled and no pair table exists.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import BROADCAST_VECTOR_BYTES, broadcast_if_small
from siftwood.functions.vectors import dot, neighbour_score
from siftwood.operators.ranking import top_k

# The kernels travel with their tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HITS = "qid bigint, doc_id string, score double"
_BLOCK = 1024  # vectors per packed block
_PRODUCT = 1 << 20  # scores held at once by a task
KEPT_ROWS = 4_000_000  # rows a task may keep between batches


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of lists as a double matrix; lists of unequal widths or without a value raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten()
    lengths = pc.list_value_length(column)
    if column.null_count or values.null_count or pc.count_distinct(lengths).as_py() != 1:
        raise ValueError("vectors must have one width and no missing values")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(qid: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k rows per query, ties to the smaller document."""
    order = np.lexsort((doc, -score, qid))
    ordered = qid[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < k]


class Best:
    """The k best documents per query seen so far in a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)  # k-th best score per query
        self.rows = (np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0))

    def add(self, at: np.ndarray, queries: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> None:
        """Multiply queries at positions ``at`` with a batch of documents."""
        order = np.argsort(ids)
        docs, ids = docs[order].T, ids[order]
        step = max(1, _PRODUCT // max(1, len(ids)))
        found = [self._candidates(at[i : i + step], queries[i : i + step] @ docs, ids) for i in range(0, len(at), step)]
        if found:
            self._merge(*(np.concatenate(column) for column in zip(*found)))

    def _candidates(self, at: np.ndarray, dots: np.ndarray, ids: np.ndarray):
        """At most k rows per query on the whole. Documents come in order of their ids, so of
        equal scores the first ones count, however many copies there are."""
        floor = self.floor[at]
        if np.isfinite(floor).all():
            # Most products can't reach the floors: only those that may are rounded.
            q, d = np.nonzero(dots >= (2.0 * floor - 1.0 - 2e-6)[:, None])
            if len(q) <= self.k * len(at):
                scores = np.round((1.0 + dots[q, d]) / 2.0, 6)
                reach = scores >= floor[q]
                return at[q[reach]], ids[d[reach]], scores[reach]
        scores = np.round((1.0 + dots) / 2.0, 6)
        n = scores.shape[1]
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        above, level = scores > floor[:, None], scores == floor[:, None]
        room = self.k - above.sum(axis=1, keepdims=True)
        q, d = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))
        return at[q], ids[d], scores[q, d]

    def _merge(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        # Only queries with new rows are ranked again.
        touched = np.zeros(len(self.floor), bool)
        touched[at] = True
        again = touched[self.rows[0]]
        rows = [np.concatenate((old[again], new)) for old, new in zip(self.rows, (at, ids, scores))]
        keep = _best(*rows, self.k)
        rows = [column[keep] for column in rows]
        # Rows are grouped by query, best first: the k-th row is the floor. All of
        # them reached the last floor, so it never falls.
        query, start, count = np.unique(rows[0], return_index=True, return_counts=True)
        full = count == self.k
        self.floor[query[full]] = rows[2][start[full] + self.k - 1]
        self.rows = tuple(np.concatenate((old[~again], new)) for old, new in zip(self.rows, rows))

    def drain(self, qids: np.ndarray) -> pa.RecordBatch:
        """The rows kept so far, which are given up; later rows still have to reach the floor."""
        out = self.batch(qids)
        self.rows = (np.zeros(0, np.int64), np.zeros(0, "U1"), np.zeros(0))
        return out

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        at, docs, scores = self.rows
        return pa.record_batch(
            [pa.array(qids[at], pa.int64()), pa.array(docs, pa.string()), pa.array(scores, pa.float64())],
            names=["qid", "doc_id", "score"],
        )


def _ids(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str)


def rows_of(batch: pa.RecordBatch, matrix: str, dtype: type) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows one at a time, with one column as numbers where they lie: a batch has
    thousands of ids a row, which must not all be Python objects at once."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names if name != matrix}, np.frombuffer(batch.column(matrix)[i].as_buffer(), dtype)


def _scan_with(qids: np.ndarray, queries: np.ndarray, k: int):
    """mapInArrow function: documents in, the task's k best per query out. Queries are
    taken block by block, so that ranking hits needs room for those of one block only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range(0, len(qids), _BLOCK)
        best = [Best(len(qids[i : i + _BLOCK]), k) for i in starts]
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, ids = as_matrix(batch.column("vec")), _ids(batch.column("doc_id"))
            for i, found in zip(starts, best):
                part = queries[i : i + _BLOCK].astype(np.float64)
                found.add(np.arange(len(part)), part, docs, ids)
        for i, found in zip(starts, best):
            yield found.drain(qids[i : i + _BLOCK])

    return scan


def _with_packed_queries(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The form for query sets beyond the broadcast bound. Queries and documents
    are packed into blocks; query blocks are copied to every lane, documents are
    dealt to lanes by key, and blocks that meet in a lane are multiplied."""
    lanes = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Packed as they are stored, so that scores don't depend on the form chosen.
    stored = {df.schema["vec"].dataType.elementType.typeName() for df in (vectors, queries)}
    kind = np.float32 if stored == {"float"} else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                matrix = as_matrix(part.column(1)).astype(kind)
                yield pa.record_batch(
                    [pa.array([part.column(0).to_pylist()]), pa.array([matrix.tobytes()], pa.binary())],
                    names=["ids", "matrix"],
                )

    docs = (
        vectors.select("doc_id", "vec")
        .mapInArrow(pack, "ids array<string>, matrix binary")
        .withColumn("lane", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(lanes)))
        .withColumnsRenamed({"ids": "doc_ids", "matrix": "doc_matrix"})
    )
    blocks = (
        queries.select("qid", "vec")
        .mapInArrow(pack, "ids array<bigint>, matrix binary")
        .withColumn("block", F.xxhash64("ids", "matrix"))
        .withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))
    )

    kept_rows = KEPT_ROWS

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One result per query block and task; what is full is handed on, its floors stay.
        held: dict[int, tuple[np.ndarray, Best]] = {}
        rows = 0
        for batch in batches:
            for row, left in rows_of(batch, "matrix", kind):
                qids, ids = np.array(row["ids"].as_py(), np.int64), _ids(row["doc_ids"].values)
                left = left.astype(np.float64).reshape(len(qids), -1)
                right = np.frombuffer(row["doc_matrix"].as_buffer(), kind).astype(np.float64).reshape(len(ids), -1)
                best = held.setdefault(row["block"].as_py(), (qids, Best(len(qids), k)))[1]
                rows -= len(best.rows[0])
                best.add(np.arange(len(qids)), left, right, ids)
                rows += len(best.rows[0])
                if rows > kept_rows:
                    for qids, best in held.values():
                        yield best.drain(qids)
                    rows = 0
        for qids, best in held.values():
            yield best.drain(qids)

    pairs = docs.join(blocks, "lane").select("doc_ids", "doc_matrix", "ids", "matrix", "block")
    return pairs.mapInArrow(multiply, HITS)


def _fits(queries: DataFrame, k: int, limit: int) -> bool:
    """Whether the query matrix and the hits a task keeps for it are small."""
    row = queries.agg(F.count("*").alias("n"), F.sum(F.size("vec")).alias("values")).first()
    return not row["n"] or (row["values"] * 8 <= limit and row["n"] * k <= KEPT_ROWS)


def _collect_queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Query ids and matrix, with numbers of the width they are stored in; the caller
    has checked the size."""
    table = queries.select("qid", "vec").toArrow()
    kind = np.float32 if queries.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    return table.column("qid").to_numpy().astype(np.int64), as_matrix(table.column("vec")).astype(kind)


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    filter: DataFrame | None = None,
    max_query_bytes: int = BROADCAST_VECTOR_BYTES,
) -> DataFrame:
    """(qid, doc_id, score, rank): the k nearest documents per query.

    Both sides hold unit vectors of one width in ``vec``; null vectors never
    match. With ``filter`` (qid, doc_id) only those pairs compete.
    """
    vectors = vectors.where(F.col("vec").isNotNull()).select("doc_id", "vec")
    queries = queries.where(F.col("vec").isNotNull()).select("qid", "vec")
    if filter is not None:
        return top_k(pair_scores(vectors, queries, filter), k)
    if not _fits(queries, k, max_query_bytes):
        return top_k(_with_packed_queries(vectors, queries, k), k, cut=False)
    packed = _collect_queries(queries)
    if not len(packed[0]):
        return top_k(vectors.sparkSession.createDataFrame([], HITS), k, cut=False)
    return top_k(vectors.mapInArrow(_scan_with(*packed, k), HITS), k, cut=False)


def pair_scores(vectors: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neighbour score of given (qid, doc_id) pairs; further columns of
    ``pairs`` are kept. Joins on the document first: a bucketed index meets
    its own matches there without a shuffle."""
    query_vecs = queries.select("qid", F.col("vec").alias("query_vec"))
    return (
        pairs.join(vectors.select("doc_id", "vec"), "doc_id")
        .join(broadcast_if_small(query_vecs, max_rows=20_000), "qid")
        .withColumn("score", neighbour_score(dot(F.col("vec"), F.col("query_vec"))))
        .drop("vec", "query_vec")
    )


def train_cells(
    vectors: DataFrame, cells: int, seed: int = 1, max_iter: int = 10, fraction: float = 1.0
) -> np.ndarray:
    """Centres of ``cells`` clusters: the only data that reaches the driver.

    Centres may be learnt from a ``fraction`` of a very large table; every
    vector is still assigned to a cell.
    """
    vectors = vectors if fraction >= 1 else vectors.sample(fraction, seed)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(points)
    return np.stack(model.clusterCenters())


# --- pooling ----------------------------------------------------------------


def mean_pool(tokens: DataFrame, key: str = "doc_id", dims: int | None = None) -> DataFrame:
    """Mean of a document's token vectors where ``mask`` is 1. All ``dims``
    components (by default those of some row) are summed side by side, one row per
    document and task, before the shuffle, so a document of any length is fine."""
    if dims is None:
        some = tokens.where(F.col("vec").isNotNull()).select(F.size("vec")).first()
        dims = some[0] if some else 0
    parts = [F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"_x{i}") for i in range(dims)]
    means = tokens.where(F.col("mask") == 1).groupBy(key).agg(F.count("vec").alias("_vectors"), *parts)
    vec = F.array(*[F.col(f"_x{i}") for i in range(dims)]).cast("array<double>")
    return means.where(F.col("_vectors") > 0).select(key, vec.alias("vec"))


def cls_pool(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """The vector of a document's first token."""
    return tokens.groupBy(key).agg(F.min_by("vec", "pos").alias("vec"))
