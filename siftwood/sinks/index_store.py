"""Versioned index tables behind an alias.

A build is a folder of parquet tables named ``<alias>_<version>``. It becomes
visible by one row appended to the alias log after all tables are written, so
readers see the old build or the new one, and a failed build is never seen.

Tables may be bucketed by document, which lets searches aggregate and join on
the document without a shuffle. Bucketing lives in the catalog, so the layout
is kept beside the tables and declared again when an index is opened.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ALIAS_SCHEMA = "alias string, index_name string, version bigint"
_LAYOUT_SCHEMA = "layout string"
_BETWEEN = "+"  # between the names of builds that one alias row names


@dataclass(frozen=True)
class Layout:
    """How one table lies on disk."""

    partition_by: str | None = None
    bucket_by: str | None = None
    sort_by: list[str] = field(default_factory=list)
    buckets: int = 0


def index_name(alias: str, version: int) -> str:
    return f"{alias}_{version}"


def new_version() -> int:
    return time.time_ns()


def _alias_log(root: str) -> str:
    return f"{root}/_aliases"


def write_table(df: DataFrame, path: str, layout: Layout) -> None:
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    if layout.partition_by:
        writer = writer.partitionBy(layout.partition_by)
    if not layout.bucket_by:
        writer.save()
        return
    name = f"siftwood_write_{uuid.uuid4().hex}"
    writer = writer.bucketBy(layout.buckets, layout.bucket_by)
    if layout.sort_by:
        writer = writer.sortBy(*layout.sort_by)
    writer.saveAsTable(name)
    # The table is external: dropping the name leaves the files.
    df.sparkSession.sql(f"DROP TABLE {name}")


def build_folder(root: str, alias: str, version: int) -> str:
    return f"{root}/{index_name(alias, version)}"


def _one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1, numPartitions=1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def write_tables(folder: str, tables: dict[str, DataFrame], layouts: dict[str, Layout]) -> dict[str, DataFrame]:
    """Write tables of a build and return them as read from there."""
    written = {}
    for name, df in tables.items():
        layout = layouts.get(name, Layout())
        write_table(df, f"{folder}/{name}", layout)
        written[name] = _read_table(df.sparkSession, folder, name, layout, df.schema)
    return written


def seal_build(spark: SparkSession, folder: str, tables: dict[str, DataFrame], layouts: dict[str, Layout]) -> None:
    """Note schema and layout of every table of a build beside them."""
    notes = {
        name: {"schema": df.schema.jsonValue(), **asdict(layouts.get(name, Layout()))} for name, df in tables.items()
    }
    _one_row(spark, layout=json.dumps(notes)).write.parquet(f"{folder}/_layout")


def switch_alias(spark: SparkSession, root: str, alias: str, version: int, names: list[str] | None = None) -> None:
    """Let an alias name a build, or several builds that are read together, oldest first."""
    named = _BETWEEN.join(names or [index_name(alias, version)])
    row = _one_row(spark, alias=alias, index_name=named).withColumn(
        "version", F.lit(version).cast("bigint")
    )
    row.write.mode("append").parquet(_alias_log(root))


def count_tables(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, in one job."""
    counts = [df.select(F.lit(name).alias("name")).groupBy("name").count() for name, df in tables.items()]
    found = {row["name"]: row["count"] for row in reduce(DataFrame.unionAll, counts).collect()}
    return {name: found.get(name, 0) for name in tables}


def publish_index(
    spark: SparkSession,
    root: str,
    alias: str,
    tables: dict[str, DataFrame],
    version: int | None = None,
    layouts: dict[str, Layout] | None = None,
) -> dict[str, int]:
    """Write a build, repoint the alias, return the rows written per table."""
    version = new_version() if version is None else version
    folder = build_folder(root, alias, version)
    written = write_tables(folder, tables, layouts or {})
    seal_build(spark, folder, written, layouts or {})
    switch_alias(spark, root, alias, version)
    return count_tables(written)


def latest_index(log: DataFrame, alias: str) -> str | None:
    """The index an alias names now: the newest row of its log."""
    row = log.where(F.col("alias") == alias).agg(F.max_by("index_name", "version").alias("name")).first()
    return row["name"] if row else None


def _catalog_name(folder: str, name: str) -> str:
    """The catalog entry that tells scans about a table's buckets. The folder's hash
    keeps equal names under different roots apart."""
    label = re.sub(r"\W", "_", f"{folder.rsplit('/', 1)[-1]}_{name}")
    return f"siftwood_{label}_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex[:12]}"


def _read_table(spark: SparkSession, folder: str, name: str, layout: Layout, schema: T.StructType) -> DataFrame:
    path = f"{folder}/{name}"
    if not layout.bucket_by:
        return spark.read.schema(schema).parquet(path)
    table = _catalog_name(folder, name)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parts = f"PARTITIONED BY (`{layout.partition_by}`)" if layout.partition_by else ""
        sort = f"SORTED BY ({', '.join(layout.sort_by)})" if layout.sort_by else ""
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet {parts} "
            f"CLUSTERED BY (`{layout.bucket_by}`) {sort} INTO {layout.buckets} BUCKETS LOCATION '{path}'"
        )
        if parts:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def _layout_notes(spark: SparkSession, folder: str) -> dict[str, dict]:
    return json.loads(spark.read.schema(_LAYOUT_SCHEMA).parquet(f"{folder}/_layout").first()["layout"])


def forget_build(spark: SparkSession, folder: str) -> None:
    """Drop the catalog entries of a build that is about to be removed."""
    try:
        notes = _layout_notes(spark, folder)
    except AnalysisException:  # it was never sealed, so nobody has opened it
        return
    for name in notes:
        spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(folder, name)}")


def open_build(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of one build."""
    tables = {}
    for name, note in _layout_notes(spark, folder).items():
        schema = T.StructType.fromJson(note.pop("schema"))
        tables[name] = _read_table(spark, folder, name, Layout(**note), schema)
    return tables


def current_builds(spark: SparkSession, root: str, alias: str) -> list[str]:
    """The builds an alias names now, oldest first; none for an unknown alias."""
    try:
        log = spark.read.schema(ALIAS_SCHEMA).parquet(_alias_log(root))
        name = latest_index(log, alias)
    except AnalysisException:  # nothing was ever published here
        return []
    return name.split(_BETWEEN) if name else []


def open_index(spark: SparkSession, root: str, alias: str) -> dict[str, DataFrame] | None:
    """The tables of the newest build that the alias names, or None for an unknown alias."""
    names = current_builds(spark, root, alias)
    return open_build(spark, f"{root}/{names[-1]}") if names else None
