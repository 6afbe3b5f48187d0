"""Mixing sources to target weights by hash thresholds.

Every document has a hash in [0, 2**60). A source takes the documents below
its threshold, so a smaller budget takes a subset of a larger one's. The
threshold comes from histograms: sizes are summed by source and leading hash
bits, the bucket in which the budget runs out is found by running sums over
at most BUCKETS rows of a source, and only that bucket is split by the next
bits, until it holds one hash. Nothing is sorted, and a hot source is summed
in parts before it is shuffled.

A source with a target above its size takes each document once and meets the
rest by a second pass of threshold. At the end the document at the threshold
is taken if that brings the source nearer to its target. Documents with equal
ids have equal hashes and go together; those without an id hash by their text.
A null source is one source, named last; null texts have size 0 and are never
taken. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.frames import SMALL_ROWS
from siftwood.operators.numbering import number_rows

WEIGHTS = [5, 2, 1]
SHARE = 1.5
CEILING = 2
HASH_BITS = 60
BITS = 12
BUCKETS = 1 << BITS

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def _hash() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, its size and hash."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash().alias("hash"))


def _named(source: str = "source") -> list[Column]:
    """A join key without nulls: whether the source is null, and its name."""
    return [F.col(source).isNull().alias("no_name"), F.coalesce(F.col(source), F.lit("")).alias("name")]


KEY = ["no_name", "name"]


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Per source: source_size and target.

    Sources in code point order, null last, have the weights in turn and share
    ``share`` of all sizes. A target stops at ``ceiling`` times the source's
    size; the excess is shared out by weight until no target is above. Each
    round is one aggregate of scalars.
    """
    by_source = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int")
    out = number_rows(by_source, KEY).withColumn("weight", F.element_at(listed, turn + 1)).drop("n")
    out = materialise(out.withColumn("most", F.lit(float(ceiling)) * F.col("source_size")), "sources")
    budget = share * (out.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        row = out.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(full.cast("bigint")), F.lit(0)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        level = (budget - row["spent"]) / row["open"] if row["open"] else level
    target = F.least(F.col("most"), F.col("weight") * F.lit(level or 0.0))
    return out.select(*KEY, "source_size", target.alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """One row per source is broadcast while there are few sources."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def thresholds(sizes: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """Per source the hash below which documents are taken, for a budget of words."""
    # low: start of the bucket the budget ends in; taken: words below it.
    found = budgets.where("budget > 0").select(*KEY, "budget", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("taken"))
    shift = HASH_BITS
    while shift:
        shift -= BITS
        inside = F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS)
        slot = F.shiftright("hash", shift).alias("slot")
        sums = (
            sizes.where("size > 0")
            .join(_small(found.select(*KEY, "low"), n_sources), KEY)
            .where(inside)
            .groupBy(*KEY, slot)
            .agg(F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        )
        upto = F.sum("words").over(W.partitionBy(*KEY).orderBy("slot"))
        sums = sums.withColumn("upto", upto).join(_small(found.select(*KEY, "budget", "taken"), n_sources), KEY).withColumn("upto", F.col("upto") + F.col("taken"))
        at = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("slot", "upto", "words", "first", "last"))).alias("at")
        found = materialise(
            sums.groupBy(*KEY, "budget").agg(at, F.max("last").alias("end"), F.max("upto").alias("all")).select(
                *KEY,
                "budget",
                F.coalesce(F.shiftleft("at.slot", shift), F.col("end") + 1).alias("low"),
                F.coalesce(F.col("at.upto") - F.col("at.words"), F.col("all")).alias("taken"),
                F.col("at.words").alias("words"),
                F.col("at.first").alias("first"),
                F.coalesce(F.col("at.first") == F.col("at.last"), F.lit(True)).alias("single"),
            ),
            "thresholds",
        )
        if found.where("NOT single").isEmpty():
            break
    # The hash at the end is taken if that comes nearer: above half of its words.
    nearer = F.col("budget") - F.col("taken") > F.col("taken") + F.col("words") - F.col("budget")
    return found.select(*KEY, F.when(nearer, F.col("first") + 1).otherwise(F.col("low")).alias("threshold"))


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sized documents; per source its size, target, whole passes and threshold; the number of sources."""
    sizes = materialise(sized(docs).select("doc_id", "size", "hash", *_named()), "sizes")
    goals = materialise(targets(sizes), "targets")
    n_sources = goals.count()
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("bigint")
    goals = goals.withColumn("whole", F.least(whole, F.lit(CEILING)))
    budgets = goals.select(*KEY, (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    return sizes, goals.join(thresholds(sizes, budgets, n_sources), KEY, "left"), n_sources


def _times() -> Column:
    extra = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """Every document with size, source_size, target and taken, its words in the
    mix: 0, 1 or 2 times its size."""
    sizes, goals, n_sources = shares(docs)
    joined = sizes.join(_small(goals, n_sources), KEY).withColumn("taken", F.col("size") * _times())
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, *columns: str) -> DataFrame:
    """The documents in the mix, with ``columns`` and times, how often each is taken."""
    _, goals, n_sources = shares(docs)
    row = F.struct(*columns).alias("row")
    rows = docs.select(row, n_words(F.col("text")).alias("size"), _hash().alias("hash"), *_named())
    rows = rows.join(_small(goals.drop("source_size"), n_sources), KEY).withColumn("times", _times().cast("int"))
    return rows.where("times > 0").select("row.*", "times")
