"""Top-k, paging, totals and result assembly."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.cluster import broadcast_if_small, materialise
from siftwood.operators.numbering import rank_deep

# The kernel travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Up to this depth Spark cuts each group before the shuffle (its default
# window group limit threshold); deeper ranks are numbered by range.
WINDOW_DEPTH = 1000

# Up to this many documents a page lookup names its keys in a filter.
PRUNED_DOCS = 500

# Rows a task holds while it looks for the best ones of each request.
HELD_ROWS = 1 << 20


def _best_of_task(k: int, held: int):
    """mapInArrow function: rows that can't be among the best ``k`` of their qid are
    left out. What is kept is handed on early where many requests fill the bound."""
    order = [("qid", "ascending"), ("score", "descending"), ("doc_id", "ascending")]

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, order))
        qid = rows.column("qid").to_numpy()
        starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
        rank = np.arange(len(qid)) - np.repeat(starts, np.diff(np.r_[starts, len(qid)]))
        return rows.filter(pa.array(rank < k))

    def floors_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Requests with k rows, and the score of the last one."""
        qids, first, count = np.unique(rows.column("qid").to_numpy(), return_index=True, return_counts=True)
        full = count == k
        return qids[full], rows.column("score").to_numpy()[first[full] + k - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, floors = [], 0, (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            plain = np.ones(batch.num_rows, bool)
            for name in ("qid", "score", "doc_id"):
                plain &= pc.is_valid(batch.column(name)).to_numpy(zero_copy_only=False)
            plain &= ~pc.fill_null(pc.is_nan(batch.column("score")), False).to_numpy(zero_copy_only=False)
            if not plain.all():  # these rank by Spark's rules alone
                yield batch.filter(pa.array(~plain))
                batch = batch.filter(pa.array(plain))
            if len(floors[0]) and batch.num_rows:
                qid, score = batch.column("qid").to_numpy(), batch.column("score").to_numpy()
                at = np.minimum(np.searchsorted(floors[0], qid), len(floors[0]) - 1)
                batch = batch.filter(pa.array((floors[0][at] != qid) | (score >= floors[1][at])))
            if batch.num_rows:
                kept.append(batch)
                waiting += batch.num_rows
            if waiting > held:
                rows = best(pa.Table.from_batches(kept).combine_chunks())
                floors = floors_of(rows)
                if rows.num_rows > held // 2:
                    yield from rows.to_batches()
                    kept, waiting = [], 0
                else:
                    kept, waiting = rows.to_batches(), rows.num_rows
        if kept:
            yield from best(pa.Table.from_batches(kept).combine_chunks()).to_batches()

    return run


def top_k(scored: DataFrame, k: int, cut: bool = True) -> DataFrame:
    """Best ``k`` hits per ``qid`` by score, ties to the smaller ``doc_id``. Each task
    first leaves out what can't be among them, without sorting all it has; ``cut``
    is for rows that are cut already."""
    best = [F.desc("score"), F.asc("doc_id")]
    if k > WINDOW_DEPTH:
        return rank_deep(scored, "qid", best).where(F.col("rank") <= k)
    kinds = [scored.schema[c].dataType for c in ("qid", "score", "doc_id")]
    if cut and k > 0 and kinds == [T.LongType(), T.DoubleType(), T.StringType()]:
        scored = scored.mapInArrow(_best_of_task(k, HELD_ROWS), scored.schema)
    ranks = F.row_number().over(W.partitionBy("qid").orderBy(*best))
    return scored.withColumn("rank", ranks).where(F.col("rank") <= k)


def page_hits(ranked: DataFrame, from_, size) -> DataFrame:
    """The page after the first ``from_`` hits; arguments may be columns."""
    start = F.lit(from_) if isinstance(from_, int) else from_
    length = F.lit(size) if isinstance(size, int) else size
    return ranked.where((F.col("rank") > start) & (F.col("rank") <= start + length))


def total_hits(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact number of hits per query before paging, 0 for none."""
    counts = matches.groupBy("qid").agg(F.count("*").alias("total"))
    return queries.select("qid").join(counts, "qid", "left").select(
        "qid", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")
    )


def select_source(hits: DataFrame, docs: DataFrame, fields: list[str], key: str = "docid") -> DataFrame:
    """Attach the named document fields to hits that are already cut to pages.

    ``docs`` is read for these columns only. A few hits are also named in a
    filter, which prunes buckets and row groups of the document table.
    """
    hits = materialise(hits.select("qid", "rank", "doc_id", "score"), "hits")
    wanted = docs.select(F.col(key).alias("doc_id"), *[F.col(f) for f in fields])
    named = [r["doc_id"] for r in hits.select("doc_id").distinct().limit(PRUNED_DOCS + 1).collect()]
    if len(named) <= PRUNED_DOCS:
        wanted = wanted.where(F.col("doc_id").isin(named))
    return wanted.join(broadcast_if_small(hits), "doc_id").select("qid", "rank", "doc_id", "score", *fields)


def assemble_results(hits: DataFrame, totals: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per request: query, total and its page of hits in rank order.

    A page is bounded by its request's ``size``, so the list stays small.
    """
    hit = F.struct("rank", "doc_id", "score")
    pages = hits.groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    none = F.array().cast("array<struct<rank:int,doc_id:string,score:double>>")
    return (
        queries.select("qid", "query")
        .join(totals, "qid", "left")
        .join(pages, "qid", "left")
        .select("qid", "query", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("hits", none).alias("hits"))
    )
