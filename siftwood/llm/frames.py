"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only below this many rows of a few numbers or short keys.
SMALL_ROWS = 100_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(docs: DataFrame, *columns: str) -> DataFrame:
    """Named columns and the text, null as empty; clashing extra columns go."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_share(doc_id: str, parts: int) -> Column:
    """crc32 of an id's decimal text modulo ``parts``; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def spread(docs: DataFrame) -> DataFrame:
    """Deal out a table of fewer splits than cores; larger ones stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of texts that a Python worker gets at once; 10,000 long texts are too many."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
