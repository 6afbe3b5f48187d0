"""Exact row numbers, pages and ranks over a total order of any size.

A global ``row_number`` window would pull every row into one task. Here rows
are range-partitioned on the order and sorted in place, the result is written
once, and each row's number is its position in its partition plus the rows in
earlier partitions. Only the per-partition counts meet in one place. The order
must be total (end in a unique column), which also splits groups of equal
leading keys over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import broadcast_if_small, materialise

# monotonically_increasing_id keeps the partition in the upper bits and the
# position inside it in the lower 33.
_POSITION_BITS = 33


def number_rows(df: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """Append ``name``: 1 for the first row in ``order``, and so on."""
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_placed", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("_placed", _POSITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition: bounded by the shuffle width, not by the data.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    position = F.col("_placed").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")
        .withColumn(name, F.col("_base") + position + 1)
        .drop("_part", "_base", "_placed")
    )


def page_rows(df: DataFrame, order: list[str | Column], per_page: int = 100) -> DataFrame:
    """Append ``page`` (from 1) and ``n``, the row's number in the order."""
    if per_page < 1:
        raise ValueError("per_page must be at least 1")
    return number_rows(df, order).withColumn("page", F.floor((F.col("n") - 1) / per_page) + 1)


def chunk_rows(df: DataFrame, order: list[str | Column], size: int = 10_000) -> DataFrame:
    """Append ``chunk`` (from 0): fixed-size runs of rows in the order."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return number_rows(df, order).withColumn("chunk", F.floor((F.col("n") - 1) / size)).drop("n")


def page_progress(df: DataFrame, total: int | None = None, per_page: int = 100) -> DataFrame:
    """After each page of a run: rows on it, rows read so far and their share of
    ``total``, all rows there are; an incremental run reads fewer. By default the
    run's own rows are all.

    Page sizes follow from the counts alone, so nothing is sorted or numbered.
    """
    rows = df.count()
    total = rows if total is None else total
    pages = df.sparkSession.range(1, (rows + per_page - 1) // per_page + 1).withColumnRenamed("id", "page")
    read = F.least(F.col("page") * per_page, F.lit(rows))
    return pages.select(
        "page",
        (read - (F.col("page") - 1) * per_page).alias("posts"),
        read.alias("read"),
        F.round(read / F.lit(total), 6).alias("share"),
    )


def rank_deep(df: DataFrame, group: str, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Rank inside each group without gathering a group in one task."""
    numbered = number_rows(df, [group, *order], "_n")
    first = numbered.groupBy(group).agg(F.min("_n").alias("_first"))
    return (
        numbered.join(broadcast_if_small(first), group)
        .withColumn(name, (F.col("_n") - F.col("_first") + 1).cast("int"))
        .drop("_n", "_first")
    )
