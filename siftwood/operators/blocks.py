"""The best documents of a request without scoring all of its matches.

Documents of a bucket are put in blocks of about equal length, since short
documents weigh their terms most, and every term has the largest weight it
reaches in each block. A request's blocks are bounded by these weights, which are
far fewer than postings. The blocks of the highest bounds are scored first and set
a floor, the request's k-th best score; only blocks whose bound reaches it are
read after that. The rest cannot hold a hit, so hits and scores are those of a
search of everything.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.cluster import BROADCAST_ROWS, broadcast_if_small, materialise
from siftwood.index import Index
from siftwood.operators.ranking import top_k
from siftwood.operators.terms import (
    FEW_TERMS,
    MATCH_ALL,
    NumberedTerms,
    asked_postings,
    bm25_weight,
    field_columns,
    matched_fields,
    posting_hit,
    query_terms,
    summed_fields,
    weigh_terms,
)

# The kernel travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["tbucket", "field", "term"]
# Blocks beyond what k documents fill that are scored first, per request.
LEAD_BLOCKS = 4
# Scores are rounded to 6 decimals, so a bound this much below a floor may still reach it.
_ROUNDING = 1e-6
_PLACE = T.StructField("place", T.IntegerType())


def doc_blocks(docs: DataFrame, fields: list[str], key: str, buckets: int, block_docs: int) -> DataFrame:
    """(doc_id, dblock): documents of each storage bucket by length, ``block_docs`` to a block."""
    length = sum((F.coalesce(F.length(F.col(f)), F.lit(0)) for f in fields), F.lit(0))
    sized = docs.select(F.col(key).cast("string").alias("doc_id"), length.alias("size"))
    sized = sized.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(buckets)))
    # A bucket has a bounded number of documents (buckets_for).
    place = F.row_number().over(W.partitionBy("bucket").orderBy("size", "doc_id")) - 1
    number = F.col("bucket").cast("bigint") * (1 << 32) + F.floor(place / block_docs)
    return sized.select("doc_id", number.alias("dblock"))


def block_weights(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(tbucket, field, term, dblock, top): the largest weight, but for idf, of a term in a block."""
    averages = F.broadcast(stats.select("field", (F.col("total_len") / F.col("n")).alias("avg_len")))
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("avg_len"), F.lit(1.0))
    return postings.join(averages, "field").groupBy(*KEYS, "dblock").agg(F.max(weight).alias("top"))


def _top_values(of_term: dict[str, np.ndarray], top: np.ndarray) -> np.ndarray:
    return of_term["idf"] * top


def _numbered(weighed: DataFrame, fields: list[str]) -> NumberedTerms | None:
    """The terms numbered, unless there are too many to send to every task."""
    return NumberedTerms(weighed) if len(fields) < 64 and 0 < weighed.count() <= BROADCAST_ROWS else None


def block_bounds(index: Index, weighed: DataFrame, fields: list[str], operator: str, numbered: NumberedTerms | None = None) -> DataFrame:
    """(qid, dblock, bound): the most a document of each block can score. For "and" a
    field counts only in blocks that have all its terms. With ``numbered`` terms the
    requests of a block are summed side by side in one task."""
    tops = asked_postings(index.tops, weighed)
    if numbered:
        by_block = tops.join(numbered.table, KEYS).groupBy("dblock").agg(F.collect_list(F.struct("t", "top")).alias("hits"))
        return numbered.summed(by_block, fields, operator, _top_values).select("qid", "dblock", F.col("total").alias("bound"))
    hit = tops.join(weighed, KEYS)
    weight = F.col("qtf") * F.col("idf") * F.col("top")
    bounds = hit.groupBy("qid", "dblock").agg(*field_columns(fields, weight))
    bounds = bounds.where(matched_fields(fields, operator))
    return bounds.select("qid", "dblock", summed_fields(fields, operator).alias("bound"))


def _scored_side_by_side(
    postings: DataFrame, numbered: NumberedTerms, blocks: DataFrame, fields: list[str], operator: str, floors: DataFrame | None
) -> DataFrame:
    """``score_blocks`` by one document after the other: its postings meet in its bucket,
    then the requests that want its block, and no pair of a posting and a request
    exists outside of a task's bounded part."""
    spark, requests = blocks.sparkSession, numbered.requests()
    places = spark.createDataFrame([(q, i) for i, q in enumerate(requests)], T.StructType([blocks.schema["qid"], _PLACE]))
    lowest = None
    if floors is not None:
        known = {r["qid"]: r["floor"] for r in floors.collect()}  # at most one row per request
        lowest = np.array([known.get(q, -np.inf) for q in requests]) - _ROUNDING
    wanted = blocks.join(F.broadcast(places), "qid").groupBy("dblock").agg(F.sort_array(F.collect_list("place")).alias("wanted"))
    # Blocks that no request wants are dropped before their postings are gathered.
    there = broadcast_if_small(blocks.select("dblock").distinct(), BROADCAST_ROWS)
    hit = postings.join(there, "dblock", "left_semi").join(numbered.table, KEYS)
    by_doc = hit.groupBy("doc_id", "dblock").agg(F.collect_list(posting_hit()).alias("hits"))
    wanted = F.broadcast(wanted) if blocks.count() <= BROADCAST_ROWS else wanted
    rows = by_doc.join(wanted, "dblock").select("doc_id", "hits", "wanted")
    return numbered.summed(rows, fields, operator, floors=lowest)


def score_blocks(
    index: Index,
    weighed: DataFrame,
    blocks: DataFrame,
    fields: list[str],
    operator: str,
    numbered: NumberedTerms | None = None,
    floors: DataFrame | None = None,
) -> DataFrame:
    """(qid, doc_id, score) of the matches in the given blocks (qid, dblock) of each
    request. With ``numbered`` terms they are summed document by document, and those
    below the ``floors`` (qid, floor) may be left out."""
    named = [r["dblock"] for r in blocks.select("dblock").distinct().limit(FEW_TERMS + 1).collect()]
    postings = asked_postings(index.postings, weighed)
    if len(named) <= FEW_TERMS:
        # Postings of a term lie in order of their block.
        postings = postings.where(F.col("dblock").isin(named))
    if numbered:
        scored = _scored_side_by_side(postings, numbered, blocks, fields, operator, floors)
        return scored.select("qid", "doc_id", F.round("total", 6).alias("score"))
    hit = postings.join(weighed, KEYS).join(broadcast_if_small(blocks.select("qid", "dblock"), BROADCAST_ROWS), ["qid", "dblock"])
    weight = F.col("qtf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("avg_len"), F.col("idf"))
    scored = hit.groupBy("qid", "doc_id").agg(*field_columns(fields, weight)).where(matched_fields(fields, operator))
    return scored.select("qid", "doc_id", F.round(summed_fields(fields, operator), 6).alias("score"))


def bm25_top(
    index: Index, queries: DataFrame, k: int, fields: list[str] | None = None, operator: str = MATCH_ALL
) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` hits per request (qid, doc_id, score, rank), and the blocks
    that were read for them (qid, dblock)."""
    if index.tops is None:
        raise ValueError("the index was built without blocks")
    text, keyword = index.split_fields(fields)
    every = text + keyword
    weighed = weigh_terms(index, query_terms(queries, text, keyword, index.analyzer), operator)
    numbered = _numbered(weighed, every)
    bounds = materialise(block_bounds(index, weighed, every, operator, numbered), "bounds")
    lead = LEAD_BLOCKS + -(-k // index.block_docs)
    order = W.partitionBy("qid").orderBy(F.desc("bound"), "dblock")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= lead)
    first = materialise(first.select("qid", "dblock"), "lead")
    begun = materialise(score_blocks(index, weighed, first, every, operator, numbered), "begun")
    # A request without k hits yet has no floor.
    floors = top_k(begun, k, cut=False).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    floors = materialise(floors, "floors")
    rest = bounds.join(broadcast_if_small(floors), "qid", "left").where(
        F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - _ROUNDING)
    )
    rest = materialise(rest.join(first, ["qid", "dblock"], "left_anti").select("qid", "dblock"), "rest")
    hits = begun.unionByName(score_blocks(index, weighed, rest, every, operator, numbered, floors))
    return top_k(hits, k), first.unionByName(rest)
