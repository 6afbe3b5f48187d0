"""What every job needs from its session: scratch tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side may hold at most this many rows of keys and scores
# (tens of bytes each), or this many bytes of query vectors.
BROADCAST_ROWS = 500_000
BROADCAST_VECTOR_BYTES = 64 << 20

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster other machines could not see one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="siftwood-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For results with several consumers: each then reads only its columns, and
    a lost executor costs a re-read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting it; leave larger sides to a
    shuffle join, where adaptive execution splits skewed keys."""
    return F.broadcast(df) if df.count() <= max_rows else df


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to all cores before
    costly per-row work. Tables of cluster size have more splits than cores and
    are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def use_utc(spark: SparkSession) -> None:
    """Days and ISO texts are cut in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)
