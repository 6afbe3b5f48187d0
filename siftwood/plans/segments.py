"""Adding to a published index without building it again.

An added batch is built as a segment of its own, with its own statistics. Keys that
it replaces are dead in the segments before it: the new segment lists them with
the document frequencies and lengths they take away. An alias then names all
segments, oldest first, and a search reads the live rows of all and sums
frequencies, so that results equal those of one build of all live records.
``merge_segments`` joins the newest ones into one when they have become many.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.cluster import broadcast_if_small, materialise
from siftwood.index import Index
from siftwood.mapping import Mapping
from siftwood.operators import index as ops
from siftwood.plans import build
from siftwood.sinks import index_store as store


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Segments:
    """The builds an alias names, oldest first."""

    def __init__(self, spark: SparkSession, root: str, alias: str):
        self.spark, self.root, self.alias = spark, root, alias
        self.names = store.current_builds(spark, root, alias)
        self.tables = [store.open_build(spark, f"{root}/{name}") for name in self.names]
        self.settings = json.loads(self.tables[0]["meta"].first()["settings"]) if self.tables else {}
        self.mapping = Mapping(self.settings["fields"], self.settings["dims"], self.settings["key"]) if self.tables else None

    def dead(self, i: int) -> DataFrame | None:
        """doc_id of the rows of a segment that later ones replaced."""
        later = [t["dead"].where(F.col("segment") == self.names[i]) for t in self.tables[i + 1 :] if "dead" in t]
        return _union(later).select("doc_id") if later else None

    def live(self, i: int, table: str, column: str = "doc_id") -> DataFrame:
        rows, dead = self.tables[i][table], self.dead(i)
        if dead is None:
            return rows
        return rows.join(broadcast_if_small(dead.withColumnRenamed("doc_id", column)), column, "left_anti").select(rows.columns)

    def every(self, table: str, column: str = "doc_id") -> DataFrame:
        return _union([self.live(i, table, column) for i in range(len(self.tables))])

    def summed(self, table: str) -> DataFrame:
        """Rows of counts, those that replaced documents take away negative."""
        names = self.tables[0][table].columns
        counts = [c for c in names if c not in ("tbucket", "field", "term", "avg_len")]
        less = [
            t[f"dead_{table}"].select(*[(-F.col(c)).alias(c) if c in counts else c for c in names if c != "avg_len"])
            for t in self.tables
            if f"dead_{table}" in t
        ]
        return _union([t[table].select(*[c for c in names if c != "avg_len"]) for t in self.tables] + less)

    def index(self) -> Index:
        """All live rows as one index; dfs holds several rows per term, to be summed."""
        stats = self.summed("stats").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len")).where("n > 0")
        return Index(
            docs=self.every("docs", self.settings["key"]),
            postings=self.every("postings"),
            dfs=self.summed("dfs"),
            lengths=self.every("lengths"),
            stats=stats.withColumn("avg_len", F.round(F.col("total_len") / F.col("n"), 6)),
            vectors=self.every("vectors"),
            mapping=self.mapping,
            term_buckets=self.settings["term_buckets"],
            doc_buckets=self.settings["doc_buckets"],
            analyzer_name=self.settings["analyzer"],
            segments=len(self.tables),
        )


def _build(segments: Segments, df: DataFrame, version: int, extra) -> None:
    """Write one segment with the settings of the first; not yet named by the alias."""
    s = segments.settings
    build.build_index(
        segments.spark, df, segments.mapping, segments.root, segments.alias, s["analyzer"], s["term_buckets"], s["doc_buckets"],
        version=version, extra=extra, publish=False,
    )


def _taken_away(segments: Segments, dead: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The replaced documents of the named segments, and the counts they take away.
    They are few beside the index and found in its buckets."""
    postings, lengths = [], []
    for name, tables in zip(names, segments.tables, strict=False):
        gone = broadcast_if_small(dead.where(F.col("segment") == name).select("doc_id"))
        postings.append(tables["postings"].join(gone, "doc_id", "left_semi"))
        lengths.append(tables["lengths"].join(gone, "doc_id", "left_semi"))
    dfs = ops.doc_freqs(_union(postings)).withColumn("tbucket", ops.term_bucket(F.col("term"), segments.settings["term_buckets"]))
    return {"dead": dead, "dead_dfs": dfs, "dead_stats": ops.field_stats(_union(lengths))}


def add_segment(spark: SparkSession, df: DataFrame, root: str, alias: str) -> list[str]:
    """Add records to the index an alias names; a key that is there already is replaced.
    Returns the names of the builds that the alias now stands for."""
    segments = Segments(spark, root, alias)
    if not segments.names:
        raise ValueError(f"no index is named {alias!r}")
    key = segments.settings["key"]

    def extra(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        added = broadcast_if_small(tables["docs"].select(F.col(key).cast("string").alias("doc_id")))
        found = []
        for i, name in enumerate(segments.names):
            old = segments.live(i, "docs", key).select(F.col(key).cast("string").alias("doc_id"))
            found.append(old.join(added, "doc_id", "left_semi").select(F.lit(name).alias("segment"), "doc_id"))
        dead = materialise(_union(found), "dead")
        return _taken_away(segments, dead, segments.names)

    version = store.new_version()
    _build(segments, df, version, extra)
    names = [*segments.names, store.index_name(alias, version)]
    store.switch_alias(spark, root, alias, version, names)
    return names


def merge_segments(spark: SparkSession, root: str, alias: str, first: int = 0) -> list[str]:
    """Build the segments from the ``first``-th on as one. What they had replaced in
    older segments stays replaced; readers of the old builds still find them."""
    segments = Segments(spark, root, alias)
    if len(segments.names) - first < 2:
        return segments.names
    key = segments.settings["key"]
    rows = _union([segments.live(i, "docs", key) for i in range(first, len(segments.names))])
    older = segments.names[:first]

    def extra(_: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if not older:
            return {}
        later = [t for t in segments.tables[first:] if "dead" in t]
        dead = _union([t["dead"].where(F.col("segment").isin(older)) for t in later])
        return _taken_away(segments, dead, older)

    version = store.new_version()
    _build(segments, rows, version, extra)
    names = [*older, store.index_name(alias, version)]
    store.switch_alias(spark, root, alias, version, names)
    return names
