"""Inverted index tables.

``postings`` shuffles the documents once, by key, and nothing after that: the
term counts of a document, its length and the bucketed write all live within
that partitioning. A frequent term is therefore spread over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions.text import tokenize
from siftwood.index import Analyzer


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _terms(df: DataFrame, key: str, fields: dict[str, Column], spread: bool) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("field"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
        for name, terms in fields.items()
    ]
    keyed = df.withColumn("doc_id", F.col(key).cast("string"))
    # Spreading by key evens out file splits before the costly analysis and
    # is the only shuffle the counts need.
    keyed = keyed.repartition("doc_id") if spread else keyed
    return keyed.select("doc_id", F.explode(F.array(*entries)).alias("e"))


def postings(
    df: DataFrame,
    fields: list[str],
    key: str = "docid",
    analyzer: Analyzer = tokenize,
    keyword_fields: list[str] = [],
    spread: bool = True,
    with_length: bool = False,
) -> DataFrame:
    """(field, term, doc_id, tf), and ``dl`` with ``with_length``: the number of
    terms the document has in that field. Turn ``spread`` off where ``df`` is
    already bucketed by key."""
    terms = {f: analyzer(F.col(f)) for f in fields}
    terms |= {f: _whole_value(F.col(f)) for f in keyword_fields}
    columns = ["field", "term", "doc_id"] + (["dl"] if with_length else [])
    return (
        _terms(df, key, terms, spread)
        .select("doc_id", "e.field", F.size("e.terms").alias("dl"), F.explode_outer("e.terms").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*columns)
        .agg(F.count("*").alias("tf"))
    )


def _whole_value(col: Column) -> Column:
    value = col.cast("string")
    return F.when(value != "", F.array(value))


def keyword_terms(df: DataFrame, fields: list[str], key: str = "docid") -> DataFrame:
    """(field, term, doc_id): whole values of keyword fields, one narrow pass."""
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("term")) for f in fields]
    return (
        df.select(F.col(key).cast("string").alias("doc_id"), F.explode(F.array(*entries)).alias("e"))
        .select("e.field", "e.term", "doc_id")
        .where(F.col("term") != "")
    )


def doc_lengths(postings: DataFrame) -> DataFrame:
    """Terms per (field, document)."""
    return postings.groupBy("field", "doc_id").agg(F.sum("tf").alias("len"))


def doc_freqs(postings: DataFrame) -> DataFrame:
    """Documents per (field, term). Counts combine before the shuffle, so a term
    in every document costs one row per partition."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """Documents with at least one term, and their mean length, per field."""
    return lengths.groupBy("field").agg(
        F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len"), F.sum("len").alias("total_len")
    )
