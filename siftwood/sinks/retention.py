"""What may be removed: old builds of an index, old buckets of a store, scratch folders.

Readers that take long hold a lease on the builds they read. A lease is a row
appended beside the alias log with the time it ends; giving it back or renewing it
appends another. A build may go once no alias names it, once what replaced it has
been visible for ``grace`` seconds, and once no lease holds it. A reader writes
its lease first and then looks again at what the alias names, so with a grace above
the time this takes, a build never goes between the two. Removing is safe to repeat.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwood.cluster import scratch_root
from siftwood.sinks import bucket_store
from siftwood.sinks import index_store as store

GRACE = 3600.0
_LEASES = "lease string, index_name string, until bigint, at bigint"
_SCRATCH_NAME = re.compile(r"[A-Za-z0-9_.]+(-[A-Za-z0-9_.]+)*-[0-9a-f]{32}")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder; whether it was there."""
    files, at = _folder(spark, path)
    return files.delete(at, True)


def _subfolders(spark: SparkSession, path: str) -> dict[str, float]:
    """Names of the folders in a folder and the seconds of their last change."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return {}
    found = [s for s in files.listStatus(at) if s.isDirectory()]
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# --- leases -----------------------------------------------------------------


@dataclass(frozen=True)
class Lease:
    spark: SparkSession
    root: str
    lease: str
    names: tuple[str, ...]

    def renew(self, seconds: float) -> None:
        """Hold the builds until ``seconds`` from now."""
        now = time.time_ns()
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(self.lease).alias("lease"),
            F.explode(F.array(*map(F.lit, self.names))).alias("index_name"),
            F.lit(now + int(seconds * 1e9)).cast("bigint").alias("until"),
            F.lit(now).cast("bigint").alias("at"),
        )
        row.write.mode("append").parquet(f"{self.root}/_leases")

    def give_back(self) -> None:
        self.renew(0)


def take_lease(spark: SparkSession, root: str, alias: str, seconds: float) -> Lease:
    """Hold what an alias names now for some seconds."""
    while True:
        names = store.current_builds(spark, root, alias)
        if not names:
            raise ValueError(f"no index is named {alias!r}")
        lease = Lease(spark, root, uuid.uuid4().hex, tuple(names))
        lease.renew(seconds)
        if store.current_builds(spark, root, alias) == names:
            return lease
        lease.give_back()


@contextmanager
def leased(spark: SparkSession, root: str, alias: str, seconds: float = 24 * 3600) -> Iterator[Lease]:
    """Hold what an alias names now until the block is left, ``seconds`` at most."""
    lease = take_lease(spark, root, alias, seconds)
    try:
        yield lease
    finally:
        lease.give_back()


def held_builds(spark: SparkSession, root: str, now: int | None = None) -> set[str]:
    """Builds that a lease holds. One row per open lease and build is read."""
    rows = _rows(spark, f"{root}/_leases", _LEASES)
    if rows is None:
        return set()
    newest = rows.groupBy("lease", "index_name").agg(F.max_by("until", "at").alias("until"))
    open_ones = newest.where(F.col("until") > F.lit(time.time_ns() if now is None else now))
    return {r[0] for r in open_ones.select("index_name").distinct().collect()}


# --- removing ---------------------------------------------------------------


def _past(grace: float) -> str:
    return f"{time.time() - grace:.3f}"


def retire_builds(spark: SparkSession, root: str, keep: int = 1, grace: float = GRACE, abandoned: float | None = None) -> list[str]:
    """Remove builds that nobody needs and return their names.

    The newest ``keep`` rows of every alias stay. With ``abandoned``, folders of
    builds that no alias has ever named go too once they are that many seconds
    old: what failed builds left. It has to be above the longest build."""
    if keep < 1:
        raise ValueError("the build an alias names must stay")
    log = _rows(spark, f"{root}/_aliases", store.ALIAS_SCHEMA)
    if log is None:
        return []
    by_alias = W.partitionBy("alias").orderBy("version")
    # A row was replaced when the file with the next row was written.
    replaced = F.lead("written").over(by_alias) < F.lit(_past(grace)).cast("double")
    rows = log.select("*", F.col("_metadata.file_modification_time").cast("double").alias("written")).select(
        "index_name", replaced.alias("replaced"), F.row_number().over(W.partitionBy("alias").orderBy(F.desc("version"))).alias("age")
    )
    named, needed = set(), set()
    for row in rows.collect():  # a row per published version
        builds = set(row["index_name"].split(store._BETWEEN))
        named |= builds
        if row["age"] <= keep or not row["replaced"]:
            needed |= builds
    there = {name: at for name, at in _subfolders(spark, root).items() if not name.startswith("_")}
    gone = {name for name in there if name in named - needed}
    if abandoned is not None:
        limit = time.time() - abandoned
        gone |= {n for n, at in there.items() if n not in named and at < limit and re.fullmatch(r".+_[0-9]+", n)}
    gone -= held_builds(spark, root)
    for name in sorted(gone):
        store.forget_build(spark, f"{root}/{name}")
        _remove(spark, f"{root}/{name}")
    return sorted(gone)


def retire_buckets(spark: SparkSession, root: str, keep: int = 1, grace: float = GRACE) -> list[str]:
    """Remove bucket folders of a store that its newest ``keep`` versions, and those
    replaced less than ``grace`` seconds ago, don't name. Returns the folders."""
    if keep < 1:
        raise ValueError("the newest version must stay")
    log = bucket_store._published(spark, root)
    if log is None:
        return []
    rows = sorted((r["version"], r["manifest"]) for r in log.collect())  # a row per version
    limit = time.time_ns() - int(grace * 1e9)
    needed, named = set(), set()
    for k, (_, manifest) in enumerate(rows):
        folders = set(json.loads(manifest)["folders"].values())
        named |= folders
        if k >= len(rows) - keep or rows[k + 1][0] >= limit:
            needed |= folders
    return [folder for folder in sorted(named - needed) if _remove(spark, f"{root}/{folder}")]


def clear_scratch(spark: SparkSession, age: float) -> list[str]:
    """Remove scratch folders that were written more than ``age`` seconds ago; that
    has to be above the longest job. Other folders in the same place stay."""
    limit = time.time() - age
    root = scratch_root(spark)
    old = [n for n, at in _subfolders(spark, root).items() if at < limit and _SCRATCH_NAME.fullmatch(n)]
    return [name for name in sorted(old) if _remove(spark, f"{root}/{name}")]
