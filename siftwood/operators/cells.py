"""Approximate neighbours from the cells of an inverted file.

Vectors are dealt to the nearest of a few centres and kept as packed blocks of
8-bit codes, sorted by cell, so a cell of any size is many rows. Queries meet the
blocks of the cells they probe in one join: the number of queries and the depth
change how many rows there are, not how many jobs. The smaller side is broadcast.
Where that are the cells, a block of queries passes all of its cells in one task,
which hands on one list a query; else queries become rows of (cell, query), packed
per cell, and each cell gives a list. Twice the wanted neighbours by code are then
scored by their own vectors.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.cluster import BROADCAST_VECTOR_BYTES, materialise, spread_small
from siftwood.functions.vectors import quantize
from siftwood.operators import neighbours
from siftwood.operators.neighbours import HITS, Best, as_matrix, pair_scores, rows_of, train_cells
from siftwood.operators.ranking import top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NPROBE = 12
# Up to this many probed cells are named to the scan, which prunes row groups.
NAMED_CELLS = 2_000
_BLOCK = 1024
_CELLS = "cell int, ids array<string>, codes binary"
_PROBES = "cell int, qids array<bigint>, asked binary"
_BLOCKS = "cell int, block bigint, qids array<bigint>, places binary, asked binary"


def centres_table(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    """(cell, centre), one row per cell."""
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1)


def read_centres(table: DataFrame) -> np.ndarray:
    """The centres as a matrix: as many rows as cells were asked for at the build."""
    return np.array([r["centre"] for r in table.orderBy("cell").collect()], np.float64)


def _nearest(centres: np.ndarray):
    half_norms = (centres**2).sum(axis=1) / 2

    @F.pandas_udf("int")
    def nearest(vec: pd.Series) -> pd.Series:
        points = np.stack(vec.to_numpy()).astype(np.float64)
        return pd.Series((points @ centres.T - half_norms).argmax(axis=1).astype(np.int32))

    return nearest


def _packed(name: str, values: str, size: int) -> Callable:
    """mapInArrow function: runs of one cell, at most ``size`` rows, as one row of
    their ids and the bytes of their codes. Rows (cell, id, code) come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            rows = []
            for a, b in zip(starts, np.r_[starts[1:], len(cell)], strict=True):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    codes = as_matrix(part.column(2)).astype(np.int8)
                    rows.append((int(cell[a]), part.column(1).to_pylist(), codes.tobytes()))
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(batch.schema.field(1).type)), pa.array([r[2] for r in rows], pa.binary())],
                names=["cell", name, values],
            )

    return run


def pack_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, ids, codes) of all vectors (doc_id, vec), sorted by cell. The range
    partition is by cell and document, so a cell of many copies is no task of its own."""
    coded = vectors.where(F.col("vec").isNotNull()).select(
        _nearest(centres)("vec").alias("cell"), "doc_id", quantize(F.col("vec")).alias("code")
    )
    coded = materialise(coded, "coded")
    placed = coded.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id")
    return placed.mapInArrow(_packed("ids", "codes", _BLOCK), _CELLS)


def _probed(centres: np.ndarray, nprobe: int) -> Callable:
    """mapInArrow function: a row (cell, qid, code) per query and cell to look at."""
    n = min(nprobe, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = as_matrix(batch.column("vec"))
            near = _nearest_cells(centres, points, n)
            codes = np.repeat(np.round(points * 127).astype(np.int8), n, axis=0)
            flat = pa.array(codes.ravel(), pa.int8())
            yield pa.record_batch(
                [
                    pa.array(near.ravel().astype(np.int32)),
                    pa.array(np.repeat(batch.column("qid").to_numpy(), n), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, points.shape[1]), pa.int32()), flat),
                ],
                names=["cell", "qid", "code"],
            )

    return run


def _nearest_cells(centres: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    return np.argsort((centres**2).sum(axis=1) / 2 - points @ centres.T, axis=1, kind="stable")[:, :n]


def _asked_blocks(centres: np.ndarray, nprobe: int, size: int) -> Callable:
    """mapInArrow function: a row per block of at most ``size`` queries and cell that some
    of them probe: all ids of the block, and places and codes of those. The rows of a
    block come one after another."""
    n = min(nprobe, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                points = as_matrix(part.column("vec"))
                codes = np.round(points * 127).astype(np.int8)
                probed = _nearest_cells(centres, points, n).ravel()
                order = np.argsort(probed, kind="stable")
                known, starts = np.unique(probed[order], return_index=True)
                places = [p.astype(np.int32) for p in np.split(order // n, starts[1:])]
                block, qids = int.from_bytes(os.urandom(7)), part.column("qid").to_pylist()
                yield pa.record_batch(
                    [
                        pa.array(known.astype(np.int32)),
                        pa.array([block] * len(known), pa.int64()),
                        pa.array([qids] * len(known), pa.list_(pa.int64())),
                        pa.array([p.tobytes() for p in places], pa.binary()),
                        pa.array([codes[p].tobytes() for p in places], pa.binary()),
                    ],
                    names=["cell", "block", "qids", "places", "asked"],
                )

    return run


def _scanned_blocks(budget: int) -> Callable:
    """mapInArrow function: blocks of queries, each with the blocks of all cells it asks,
    in; the best ``budget`` by code of each query out. One block of queries is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, qids, best = None, np.zeros(0, np.int64), Best(0, budget)
        for batch in batches:
            for row, codes in rows_of(batch, "codes", np.int8):
                if row["block"].as_py() != block:
                    yield best.drain(qids)
                    block, qids = row["block"].as_py(), np.array(row["qids"].as_py(), np.int64)
                    best = Best(len(qids), budget)
                places = np.frombuffer(row["places"].as_buffer(), np.int32)
                asked = np.frombuffer(row["asked"].as_buffer(), np.int8).astype(np.float64).reshape(len(places), -1) / 127
                ids = np.array(row["ids"].as_py(), str)
                best.add(places, asked, codes.astype(np.float64).reshape(len(ids), -1) / 127, ids)
        yield best.drain(qids)

    return run


def _scanned(budget: int, kept_rows: int) -> Callable:
    """mapInArrow function: blocks of a cell with blocks of its queries in, the best
    ``budget`` by code of each query out. At most about ``kept_rows`` rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, Best]] = {}

        def drained() -> Iterator[pa.RecordBatch]:
            for qids, best in held.values():
                yield best.drain(qids)

        for batch in batches:
            for row, codes in rows_of(batch, "codes", np.int8):
                cell = row["cell"].as_py()
                key = (cell, row["qids"][0].as_py())
                if key not in held:
                    if any(other != cell for other, _ in held):  # cells come one after another
                        yield from drained()
                        held = {}
                    held[key] = (np.array(row["qids"].as_py(), np.int64), Best(len(row["qids"]), budget))
                qids, best = held[key]
                ids = np.array(row["ids"].as_py(), str)
                docs = codes.astype(np.float64).reshape(len(ids), -1) / 127
                asked = np.frombuffer(row["asked"].as_buffer(), np.int8).astype(np.float64).reshape(len(qids), -1) / 127
                best.add(np.arange(len(qids)), asked, docs, ids)
                if sum(len(b.rows[0]) for _, b in held.values()) > kept_rows:
                    yield from drained()
        yield from drained()

    return run


def _by_cell(
    cells: DataFrame, centres: np.ndarray, queries: DataFrame, budget: int, nprobe: int, size: int, max_query_bytes: int
) -> DataFrame:
    """Hits by code of queries that are packed per cell, a list for each cell and task."""
    probes = materialise(queries.mapInArrow(_probed(centres, nprobe), "cell int, qid bigint, code array<tinyint>"), "probes")
    packed = probes.repartitionByRange("cell", "qid").sortWithinPartitions("cell", "qid").mapInArrow(_packed("qids", "asked", size), _PROBES)
    packed = materialise(packed, "packed")
    # One row per cell at most; the cells were counted when they were trained.
    named = [r["cell"] for r in packed.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
    near = cells.where(F.col("cell").isin(named)) if len(named) <= NAMED_CELLS else cells
    told = packed.agg(F.coalesce(F.sum(F.octet_length("asked") + 8 * F.size("qids")), F.lit(0))).first()[0]
    # Where queries are shuffled they come first: each passes its cell as a whole.
    pairs = near.join(F.broadcast(packed), "cell") if told <= max_query_bytes else packed.join(near, "cell")
    return pairs.select("cell", "ids", "codes", "qids", "asked").mapInArrow(_scanned(budget, neighbours.KEPT_ROWS), HITS)


def knn_approx(
    cells: DataFrame,
    centres: np.ndarray,
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int = NPROBE,
    max_query_bytes: int = BROADCAST_VECTOR_BYTES,
) -> DataFrame:
    """(qid, doc_id, score, rank) from the ``nprobe`` nearest cells of each query.

    ``cells`` is what ``pack_cells`` made of ``vectors``. Null query vectors match nothing."""
    budget, kept = 2 * k, neighbours.KEPT_ROWS
    size = max(1, min(_BLOCK, kept // budget))
    queries = queries.where(F.col("vec").isNotNull()).select("qid", "vec")
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    stored = cells.agg(F.coalesce(F.sum(F.octet_length("codes") + 16 * F.size("ids")), F.lit(0))).first()[0]
    if stored <= min(max_query_bytes, asked["n"] * min(nprobe, len(centres)) * (asked["width"] + 8)):
        blocks = spread_small(queries).mapInArrow(_asked_blocks(centres, nprobe, size), _BLOCKS)
        pairs = blocks.join(F.broadcast(cells), "cell").select("ids", "codes", "block", "qids", "places", "asked")
        found = pairs.mapInArrow(_scanned_blocks(budget), HITS)
    else:
        found = _by_cell(cells, centres, queries, budget, nprobe, size, max_query_bytes)
    candidates = materialise(top_k(found, budget, cut=False).select("qid", "doc_id"), "candidates")
    return top_k(pair_scores(vectors, queries, candidates), k, cut=False)


__all__ = ["centres_table", "knn_approx", "pack_cells", "read_centres", "train_cells"]
