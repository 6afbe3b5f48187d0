"""Hard negatives by an inverted multi-index with certified bounds.

The two halves of a vector are quantised by codebooks of their own, and every
half centroid knows the radius of what it stands for. A row's half score with an
anchor is then at most the centroid's plus the anchor half's length times that
radius, and a cell, a pair of centroids, is bounded by the sum of both. Anchors
walk cells by that bound with a heap over both ordered codebooks. The first
cells, until they hold FIRST_ROWS rows, give preliminary results; the rest of
the walk stops where the bound shows that no further cell can change a window.
This is done twice: for the positives, and for the window of negatives below
each of them. So the results are those of an exhaustive search.

Components are whole numbers, floor(256 x) in doubles, kept within a long, and so
are scores, computed exactly (in doubles while they fit 53 bits, else as Python
integers) and kept within a long. Codebooks are fitted on at most SAMPLE_ROWS
rows or SAMPLE_BYTES; radii, counts and the search cover all rows. Cells are
dealt to blocks of equal size, a larger cell is split by a hash of the id, and a
block is copied only as often as its anchors fill tasks.

Rows with a null id, label or vector, or with a null or non-finite component
take no part. Zero and empty vectors do; shorter vectors count as if they ended
in zeros. Of several rows of one id the least (label, vector) is that id's row.
``%`` keeps the sign of a negative number.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.frames import spread
from siftwood.llm.multi_index import _k_means, _squares

POSITIVES = 5
NEGATIVES = 5
ANCHOR_STEP = 100
# A negative scores at least LEAST / 100 and at most 100 / 100 of the positive.
LEAST = 80

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 16 << 20
MOST_CENTROIDS = 1024
FIRST_ROWS = 4_000
BLOCK_ROWS = 8_192
BLOCK_BYTES = 16 << 20
BLOCK_ANCHORS = 4_096
AT_ONCE = 128
# Cells that a frame of asked blocks names, and those of one more anchor.
ASKED_CELLS = 1 << 18
_EXACT = 2.0**53
_LONG = 2**63


@dataclass(frozen=True)
class Cells:
    """Codebooks with radii, and per cell its rows."""

    left: np.ndarray
    right: np.ndarray
    left_radii: np.ndarray
    right_radii: np.ndarray
    counts: np.ndarray

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most that a row of each half centroid can score with the anchor's half."""
        cut = self.left.shape[1]
        out = []
        for half, book, radii in ((anchor[:cut], self.left, self.left_radii), (anchor[cut:], self.right, self.right_radii)):
            length = np.sqrt((half * half).sum())
            bound = book @ half + length * radii
            # What rounding may have taken away, and one whole number.
            out.append(bound + 1e-9 * length * (np.sqrt((book * book).sum(1)) + radii) + 1)
        return out[0], out[1]


def walk(cells: Cells, anchor: np.ndarray) -> Iterator[tuple[int, float]]:
    """Cells that hold rows, with their bounds, the highest bound first."""
    a, b = cells.bounds(anchor)
    rows, columns = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y = a[rows].tolist(), b[columns].tolist()
    rows, columns, width = rows.tolist(), columns.tolist(), len(y)
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        cell = rows[i] * width + columns[j]
        if cells.counts[cell]:
            yield cell, -bound
        # Each pair has one parent: right along its row, down from the first column.
        if j + 1 < width:
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vec, whole numbers, of the rows that take part."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256))
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    vec_id = F.col("vec_id").cast("bigint")
    label = F.col("label").cast("bigint")
    changed = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.where(F.forall(F.col("embedding").cast("array<double>"), finite))
    rows = rows.select(vec_id.alias("vec_id"), changed.alias("label"), whole.alias("vec")).dropna()
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.*")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros; exact, as objects if longs don't fit doubles."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all anchors, whole numbers within a long."""
    x, y = rows.astype(float), anchors.astype(float)
    if np.abs(x).max(initial=0) * np.abs(y).sum(1).max(initial=0) < _EXACT:
        return (y @ x.T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, -_LONG, _LONG - 1).astype(np.int64)


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows by score, ties by smaller id. Ids are ascending."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
        at = np.r_[above, level[: k - len(above)]]
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def lowest(positive: int) -> int:
    """The least whole score of a negative in a positive's window."""
    return -(-LEAST * positive // 100)


# --- asking blocks ---------------------------------------------------------------

# An anchor's goals are empty while its positives are looked for, then its positives' scores.
_ANCHOR = "anchor_id bigint, label bigint, vec array<bigint>, goals array<bigint>"
_ASKED = "block bigint, spot bigint, " + _ANCHOR + ", cells array<int>"
_FOUND = "anchor_id bigint, goal bigint, vec_id bigint, score bigint"


def _ask(shared, placed, width: int, first: bool) -> Callable:
    """Per anchor and block the cells to look at there: of the first part of its walk, or of
    the rest down to its floor (null: to the end). A walk may name most cells, so what is
    held is what a few anchors name, however many come in a batch."""
    columns, most = [c.split()[0] for c in _ASKED.split(", ")], ASKED_CELLS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, (first_block, n_blocks) = shared.value, placed.value
        for batch in batches:
            out, n = [], 0
            for row in batch.itertuples(index=False):
                anchor = _matrix(pd.Series([row.vec]), width)[0].astype(float)
                found, held = array("i"), 0
                for cell, bound in walk(cells, anchor):
                    begun, held = held < FIRST_ROWS, held + int(cells.counts[cell])
                    if first and not begun or not first and row.floor == row.floor and row.floor is not None and bound < row.floor:
                        break
                    if first or not begun:
                        found.append(cell)
                named = np.array(found, np.int32)
                copies = n_blocks[named]
                offset = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                blocks, named = np.repeat(first_block[named], copies) + offset, np.repeat(named, copies)
                order = np.argsort(blocks, kind="stable")
                known, starts = np.unique(blocks[order], return_index=True)
                for b, some in zip(known.tolist(), np.split(named[order], starts[1:])):
                    out.append((b, row.anchor_id, row.anchor_id, row.label, row.vec, row.goals, some))
                n += len(named)
                if n >= most:
                    yield pd.DataFrame(out, columns=columns)
                    out, n = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return run


def _search(width: int) -> Callable:
    """Rows of a block for its anchors: the first of each goal's window, or of its own label."""

    def run(key, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked):
            entries = entries.sort_values("vec_id")
            ids, labels = entries["vec_id"].to_numpy(), entries["label"].to_numpy()
            known, cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            points = _matrix(entries["vec"], width)
            for start in range(0, len(asked), AT_ONCE):
                some = asked.iloc[start : start + AT_ONCE]
                products = scores(points, _matrix(some["vec"], width))
                for score, row in zip(products, some.itertuples(index=False), strict=True):
                    probed = np.zeros(len(known), bool)
                    probed[np.searchsorted(known, row.cells)[np.isin(row.cells, known)]] = True
                    same = labels == row.label
                    if len(row.goals):
                        at = np.flatnonzero(probed[cell] & ~same)
                        windows = [(int(g), at[(score[at] >= lowest(int(g))) & (score[at] <= g)]) for g in set(row.goals)]
                    else:
                        windows = [(0, np.flatnonzero(probed[cell] & same & (ids != row.anchor_id)))]
                    for goal, here in windows:
                        best = here[_first(ids[here], score[here], NEGATIVES if len(row.goals) else POSITIVES)]
                        out.append(np.stack([np.full(len(best), row.anchor_id), np.full(len(best), goal), ids[best], score[best]]))
        columns = [c.split()[0] for c in _FOUND.split(", ")]
        return pd.DataFrame(dict(zip(columns, np.concatenate(out, 1) if out else np.empty((4, 0), np.int64), strict=True)))

    return run


class _Index:
    """All rows by cell and block, and how anchors ask them."""

    def __init__(self, rows: DataFrame, sample: np.ndarray, n: int, width: int):
        spark = rows.sparkSession
        k = int(2 ** np.clip(np.round(np.log2(max(n, 1) ** 0.5 / 4)), 0, np.log2(MOST_CENTROIDS)))
        cut = (width + 1) // 2
        left, right = _k_means(sample[:, :cut], k), _k_means(sample[:, cut:], k)
        books = spark.sparkContext.broadcast((left, right))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                points = _matrix(batch["vec"], width).astype(float)
                halves = [(points[:, :cut], books.value[0]), (points[:, cut:], books.value[1])]
                own = [_squares(x, book).argmin(1) for x, book in halves]
                far = [np.sqrt(np.square(x - book[i]).sum(1)) for (x, book), i in zip(halves, own, strict=True)]
                yield batch.assign(cell=own[0] * len(books.value[1]) + own[1], left_far=far[0], right_far=far[1])

        schema = "vec_id bigint, label bigint, vec array<bigint>, cell int, left_far double, right_far double"
        self.rows = materialise(rows.mapInPandas(assign, schema), "cells")
        # At most MOST_CENTROIDS ** 2 rows of four numbers.
        counts = np.zeros(len(left) * len(right), np.int64)
        radii = [np.zeros(len(left)), np.zeros(len(right))]
        told = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("left_far").alias("l"), F.max("right_far").alias("r"))
        for row in told.collect():
            i, j = divmod(row["cell"], len(right))
            counts[row["cell"]] = row["n"]
            radii[0][i], radii[1][j] = max(radii[0][i], row["l"]), max(radii[1][j], row["r"])
        # Small tables get small blocks, so that they too are dealt to many tasks.
        size = int(min(BLOCK_ROWS, max(512, n // 32), max(256, BLOCK_BYTES // (8 * width))))
        n_blocks = np.maximum(-(-counts // size), 1)
        small = n_blocks == 1
        packed = np.cumsum(np.where(small, counts, 0)) // size
        first_block = np.where(small, packed, packed.max() + 1 + np.cumsum(np.where(small, 0, n_blocks)) - n_blocks)
        self.width = width
        self.cells = spark.sparkContext.broadcast(Cells(left, right, *radii, counts))
        self.placed = spark.sparkContext.broadcast((first_block, n_blocks))
        where = pd.DataFrame({"cell": np.arange(len(counts)), "first": first_block, "blocks": n_blocks})[counts > 0]
        place = F.broadcast(spark.createDataFrame(where, "cell int, first long, blocks long"))
        block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
        self.entries = self.rows.join(place, "cell").select(block.alias("block"), "vec_id", "label", "vec", "cell")

    def find(self, anchors: DataFrame, first: bool) -> DataFrame:
        """(anchor_id, goal, vec_id, score) of the first or the remaining cells of ``anchors``
        (anchor_id, label, vec, goals, floor), not yet cut over blocks."""
        asked = materialise(spread(anchors).mapInPandas(_ask(self.cells, self.placed, self.width, first), _ASKED), "asked")
        parts = asked.groupBy("block").agg((F.floor((F.count("*") - 1) / BLOCK_ANCHORS) + 1).alias("parts"))
        parts = materialise(parts, "parts")
        # Only blocks that are asked are sent, once for every BLOCK_ANCHORS anchors.
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
        entries = self.entries.join(F.broadcast(parts) if parts.count() <= 100_000 else parts, "block").select(*self.entries.columns, part)
        asked = asked.join(F.broadcast(parts) if parts.count() <= 100_000 else parts, "block")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("spot"), F.col("parts"))).drop("parts")
        return entries.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(_search(self.width), _FOUND)


def _cut(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of every anchor's goal."""
    order = W.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _both(index: _Index, anchors: DataFrame, k: int, floor, label: str) -> DataFrame:
    """The first k rows of every goal: preliminary ones, then all that may beat them."""
    begun = materialise(_cut(index.find(anchors, True), k), label)
    asked = materialise(floor(begun, anchors), "floors")
    rest = index.find(asked, False)
    return materialise(_cut(begun.drop("rank").unionAll(rest), k), label)


def _positive_floor(begun: DataFrame, anchors: DataFrame) -> DataFrame:
    last = begun.where(F.col("rank") == POSITIVES).select("anchor_id", F.col("score").cast("double").alias("floor"))
    return anchors.drop("floor").join(last, "anchor_id", "left").select("anchor_id", "label", "vec", "goals", "floor")


def _window_floor(begun: DataFrame, anchors: DataFrame) -> DataFrame:
    """The least bound that can still matter to one of an anchor's windows: a full
    window's last score, else where the window ends."""
    goals = anchors.select("anchor_id", F.explode(F.array_distinct("goals")).alias("goal"))
    last = begun.where(F.col("rank") == NEGATIVES).select("anchor_id", "goal", F.col("score").alias("last"))
    end = F.col("goal").cast("double") * (LEAST / 100) - F.abs("goal") * 1e-9 - 1
    floors = goals.join(last, ["anchor_id", "goal"], "left").groupBy("anchor_id").agg(F.min(F.coalesce(F.col("last").cast("double"), end)).alias("floor"))
    return anchors.drop("floor").join(floors, "anchor_id").select("anchor_id", "label", "vec", "goals", "floor")


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of
    the first negatives in the window of each of an anchor's first positives."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors), "vectors")
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    n, width = told["n"], max(told["width"], 2)
    nothing = "anchor_id bigint, positive_id bigint, rank bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], nothing)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    spots = 1 << 30
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(spots)) < int(spots * min(1.0, most / n))
    sample = rows.where(chosen).orderBy("vec_id").limit(2 * most).select("vec").toPandas()["vec"]
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(most).select("vec").toPandas()["vec"]
    index = _Index(rows, _matrix(sample, width).astype(float), n, width)

    anchors = rows.where(F.col("vec_id") % ANCHOR_STEP == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    none = F.array().cast("array<bigint>")
    asked = materialise(anchors.withColumns({"goals": none, "floor": F.lit(None).cast("double")}), "anchors")
    positives = _both(index, asked, POSITIVES, _positive_floor, "positives")
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # At most POSITIVES of an anchor. No window below a negative positive holds a score.
    goals = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("goals"))
    asked = materialise(asked.drop("goals").join(goals, "anchor_id").select("anchor_id", "label", "vec", "goals", "floor"), "anchors")
    negatives = _both(index, asked, NEGATIVES, _window_floor, "negatives")
    negatives = negatives.select(
        "anchor_id", F.col("goal").alias("positive_score"), F.col("rank").cast("bigint").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    found = positives.join(negatives, ["anchor_id", "positive_score"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
