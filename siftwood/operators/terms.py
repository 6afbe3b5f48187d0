"""Term matching and BM25 over a published index.

The query side is written once and broadcast after a size check. Postings are
read only in the term buckets the queries touch and are bucketed by document,
so the score of a document is summed without a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.cluster import BROADCAST_ROWS, materialise
from siftwood.functions.text import tokenize
from siftwood.index import Analyzer, Index
from siftwood.operators.index import term_bucket

# The kernel travels with its tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the similarity.
K1 = 2.0
B = 0.75

MATCH_ALL = "and"
MATCH_ANY = "or"

# Query terms that are named to the scan of postings one by one.
FEW_TERMS = 200

# Pairs of a posting and a query term that a task holds at once, above one document's.
HELD_PAIRS = 1 << 20


def query_terms(
    queries: DataFrame,
    fields: list[str],
    keyword_fields: list[str] = [],
    analyzer: Analyzer = tokenize,
) -> DataFrame:
    """(qid, field, n_terms, term, qtf): the distinct terms each query asks of
    each field. A keyword field is asked for the whole query text. Where the
    queries have ``search_fields``, a row's own fields are used, or all given
    ones if it is null."""
    none = F.array().cast("array<string>")
    analysed = F.coalesce(analyzer(F.col("query")), none)
    whole = F.when(F.col("query") != "", F.array("query")).otherwise(none)
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), analysed.alias("terms")) for f in fields],
        *[F.struct(F.lit(f).alias("field"), whole.alias("terms")) for f in keyword_fields],
    )
    if "search_fields" in queries.columns:
        named = F.col("search_fields")
        entries = F.filter(entries, lambda e: named.isNull() | F.array_contains(named, e["field"]))
    return (
        queries.select("qid", F.explode_outer(entries).alias("e"))
        .select("qid", "e.field", F.size(F.array_distinct("e.terms")).alias("n_terms"), F.explode_outer("e.terms").alias("term"))
        .where(F.col("n_terms") > 0)
        .groupBy("qid", "field", "n_terms", "term")
        .agg(F.count("*").alias("qtf"))
    )


def weigh_terms(index: Index, terms: DataFrame, operator: str = MATCH_ANY) -> DataFrame:
    """Attach idf and the field's mean length to query terms. Terms that no
    document has drop out; for "and" so does all the query asks of that field,
    since nothing can match it, before any postings are read."""
    terms = materialise(terms.withColumn("tbucket", term_bucket(F.col("term"), index.term_buckets)), "terms")
    small = terms.count() <= BROADCAST_ROWS
    wanted = F.broadcast(terms) if small else terms
    # One row per field of the mapping.
    stats = F.broadcast(index.stats.select("field", "n", (F.col("total_len") / F.col("n")).alias("avg_len")))
    asked = index.dfs.join(wanted, ["tbucket", "field", "term"])
    if index.segments > 1:
        asked = asked.groupBy(wanted.columns).agg(F.sum("df").alias("df")).where("df > 0")
    weighed = (
        asked.join(stats, "field")
        .withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .select("tbucket", "field", "term", "qid", "n_terms", "qtf", "idf", "avg_len")
    )
    if operator == MATCH_ALL:
        of_field = W.partitionBy("qid", "field")
        rarest = F.row_number().over(of_field.orderBy(F.desc("idf"), "term")) == 1
        weighed = weighed.withColumns({"known": F.count("*").over(of_field), "rarest": rarest})
        weighed = weighed.where(F.col("known") == F.col("n_terms")).drop("known")
    weighed = materialise(weighed, "weighed")
    # At most one row per query term, so the count above bounds it too.
    return F.broadcast(weighed) if small else weighed


def asked_postings(postings: DataFrame, weighed: DataFrame) -> DataFrame:
    """Postings that the queries can touch, by what a scan can skip: the term
    buckets, and the terms themselves while they are few, else their range. At
    most FEW_TERMS terms, or one number per bucket, come to the driver."""
    few = weighed.select("tbucket", "field", "term").distinct().limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        buckets, fields, terms = (sorted({r[k] for r in few}) for k in ("tbucket", "field", "term"))
        named = F.col("field").isin(fields) & F.col("term").isin(terms)
    else:
        row = weighed.agg(F.collect_set("tbucket"), F.min("term"), F.max("term")).first()
        buckets, named = row[0], F.col("term").between(row[1], row[2])
    return postings.where(F.col("tbucket").isin(buckets) & named)


def bm25_weight(tf: Column, dl: Column, avg_len: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


def rarest_first(index: Index, weighed: DataFrame) -> DataFrame:
    """Postings of "and" requests with their weighed terms: of a field asked for
    several terms only the documents of its rarest one. These documents are found
    first and written; up to BROADCAST_ROWS of them filter the other terms'
    postings where they are scanned, so a term that is everywhere adds no more
    rows than the rarest. Beyond that the aggregate decides alone, with equal rows."""
    keys = ["tbucket", "field", "term"]
    found = asked_postings(index.postings, weighed).join(weighed, keys)
    lead = weighed.where("n_terms > 1 AND rarest")
    lead = materialise(asked_postings(index.postings, lead).join(lead, keys).select("qid", "field", "doc_id"), "rarest")
    if lead.count() > BROADCAST_ROWS:
        return found.drop("rarest")
    listed = F.broadcast(lead.withColumn("listed", F.lit(True)))
    found = found.join(listed, ["qid", "field", "doc_id"], "left")
    return found.where("n_terms = 1 OR listed").drop("rarest", "listed")


def field_columns(fields: list[str], weight: Column) -> list[Column]:
    """Aggregates per field: distinct query terms found (``m_``) and asked for
    (``n_``), and the sum of their weights (``s_``)."""
    columns = []
    for f in fields:
        here = F.col("field") == f
        columns += [
            F.count_if(here).alias(f"m_{f}"),
            F.max(F.when(here, F.col("n_terms"))).alias(f"n_{f}"),
            F.sum(F.when(here, weight)).alias(f"s_{f}"),
        ]
    return columns


def _field_scores(index: Index, weighed: DataFrame, fields: list[str]) -> DataFrame:
    """``field_columns`` per (qid, doc_id), in one aggregate keyed by the document."""
    if "rarest" in weighed.columns:
        hit = rarest_first(index, weighed)
    else:
        hit = asked_postings(index.postings, weighed).join(weighed, ["tbucket", "field", "term"])
    weight = F.col("qtf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("avg_len"), F.col("idf"))
    return hit.groupBy("qid", "doc_id").agg(*field_columns(fields, weight))


def bm25_values(of_term: dict[str, np.ndarray], tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    idf, avg_len = of_term["idf"], of_term["avg_len"]
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


def _summed_requests(
    asked: pa.Table, starts: np.ndarray, fields: list[str], operator: str, held: int, values: Callable, floors: np.ndarray | None
):
    """mapInArrow function: rows of a key and its ``hits`` (term number and what
    ``values`` weighs) in, a row per request that matches out. ``asked`` has the weighed
    terms in order of their number, those of number t from ``starts[t]`` on. Rows may
    name the requests to look at, by place and in order, as ``wanted``. Totals below the
    ``floors`` of their requests are left out."""
    qid = pc.dictionary_encode(asked.column("qid").combine_chunks(), null_encoding="encode")
    qids, q = qid.dictionary, qid.indices.to_numpy().astype(np.int64)
    place = np.array([fields.index(f) for f in asked.column("field").to_pylist()], np.int64)
    number = lambda name: asked.column(name).to_numpy().astype(np.float64)
    qtf, idf, avg_len, n_terms = map(number, ("qtf", "idf", "avg_len", "n_terms"))
    every = np.diff(starts)

    def score(row: np.ndarray, t: np.ndarray, given: list[np.ndarray], wanted: np.ndarray | None):
        times = every[t]
        at = np.repeat(starts[t] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        row, *given = (np.repeat(x, times) for x in (row, *given))
        pair = row * len(qids) + q[at]
        if wanted is not None:
            there = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
            pair, at, given = pair[there], at[there], [x[there] for x in given]
        if not len(pair):
            return pair, np.zeros(0), pair
        weight = qtf[at] * values({"idf": idf[at], "avg_len": avg_len[at]}, *given)
        order = np.argsort(pair, kind="stable")
        pair, weight, at = pair[order], weight[order], at[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        total, mask = np.zeros(len(first)), np.zeros(len(first), np.int64)
        for k in np.unique(place[at]):
            here = place[at] == k
            found = np.add.reduceat(here, first, dtype=np.int64)
            matched = found > 0
            if operator == MATCH_ALL:
                matched &= found == np.maximum.reduceat(np.where(here, n_terms[at], 0), first)
            total += np.where(matched, np.add.reduceat(np.where(here, weight, 0.0), first), 0.0)
            mask |= np.where(matched, 1 << int(k), 0)
        keep = mask != 0
        if floors is not None:
            keep &= total >= floors[pair[first] % len(qids)]
        kept = np.flatnonzero(keep)
        return pair[first[kept]], total[kept], mask[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits = batch.column(0), batch.column(1)
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.list_value_length(hits).to_numpy().astype(np.int64))
            hit = hits.flatten()
            t, *given = (hit.field(i).to_numpy(zero_copy_only=False) for i in range(hit.type.num_fields))
            row = np.repeat(np.arange(len(keys)), np.diff(np.r_[0, ends]))
            done = np.cumsum(every[t])[ends - 1]  # pairs up to each row
            wanted = None
            if batch.num_columns > 2:
                named = batch.column(2)
                until = np.cumsum(pc.list_value_length(named).to_numpy().astype(np.int64))
                named = named.flatten().to_numpy(zero_copy_only=False)
                done = done + until
            begin = 0
            while begin < len(keys):
                before = done[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(done, before + held, side="right")))
                part = slice(ends[begin - 1] if begin else 0, ends[end - 1])
                if batch.num_columns > 2:
                    lengths = np.diff(np.r_[0, until])[begin:end]
                    wanted = named[until[begin - 1] if begin else 0 : until[end - 1]]
                    wanted = np.repeat(np.arange(begin, end) * len(qids), lengths) + wanted
                pair, total, mask = score(row[part], t[part], [x[part].astype(np.float64) for x in given], wanted)
                yield pa.record_batch(
                    [qids.take(pa.array(pair % len(qids))), keys.take(pa.array(pair // len(qids))), pa.array(total), pa.array(mask)],
                    names=["qid", batch.schema.names[0], "total", "matched"],
                )
                begin = end

    return run


class NumberedTerms:
    """Weighed terms (at most BROADCAST_ROWS) with a number per term, for sums over all
    requests of a row in the task that has it: what a task holds follows from its
    postings, not from the number of requests they answer."""

    def __init__(self, weighed: DataFrame):
        keys = ["tbucket", "field", "term"]
        asked = weighed.toArrow()
        asked = asked.sort_by([(c, "ascending") for c in keys])
        new = np.zeros(asked.num_rows, bool)
        for c in keys:
            column = asked.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        new[:1] = True
        starts = np.flatnonzero(new)
        named = asked.take(pa.array(starts)).select(keys).append_column("t", pa.array(np.arange(len(starts), dtype=np.int32)))
        schema = T.StructType([*[weighed.schema[c] for c in keys], T.StructField("t", T.IntegerType())])
        self.table = F.broadcast(weighed.sparkSession.createDataFrame(named.to_pylist(), schema))
        self.starts = np.r_[starts, asked.num_rows]
        self.asked = asked.select(["qid", "field", "n_terms", "qtf", "idf", "avg_len"])
        self.kind = weighed.schema["qid"].dataType

    def requests(self) -> list:
        """The requests in the order that ``wanted`` and ``floors`` name them by."""
        qid = self.asked.column("qid").combine_chunks()
        return pc.dictionary_encode(qid, null_encoding="encode").dictionary.to_pylist()

    def summed(
        self, rows: DataFrame, fields: list[str], operator: str, values: Callable = bm25_values, floors: np.ndarray | None = None
    ) -> DataFrame:
        """(qid, key, total, matched) of rows (key, hits) or (key, hits, wanted)."""
        run = _summed_requests(self.asked, self.starts, fields, operator, HELD_PAIRS, values, floors)
        out = [T.StructField("qid", self.kind), rows.schema[0], T.StructField("total", T.DoubleType()), T.StructField("matched", T.LongType())]
        return rows.mapInArrow(run, T.StructType(out))


def posting_hit() -> Column:
    return F.struct("t", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


def _totals_by_document(index: Index, weighed: DataFrame, fields: list[str], operator: str) -> DataFrame:
    """``_totals`` by one document after the other. The postings of a document meet in
    its bucket; the requests they answer are summed in the task that has them."""
    numbered = NumberedTerms(weighed)
    hit = asked_postings(index.postings, weighed).join(numbered.table, ["tbucket", "field", "term"])
    by_doc = hit.groupBy("doc_id").agg(F.collect_list(posting_hit()).alias("hits"))
    return numbered.summed(by_doc, fields, operator)


def _matches(field: str, operator: str) -> Column:
    found = F.col(f"m_{field}")
    # n_ is null where the field has no hit at all.
    return F.coalesce(found == F.col(f"n_{field}"), F.lit(False)) if operator == MATCH_ALL else found > 0


def matched_fields(fields: list[str], operator: str) -> Column:
    """Whether any field matches."""
    return reduce(lambda a, b: a | b, [_matches(f, operator) for f in fields])


def summed_fields(fields: list[str], operator: str) -> Column:
    """The sum over the fields that match."""
    return reduce(lambda a, b: a + b, [F.when(_matches(f, operator), F.col(f"s_{f}")).otherwise(0.0) for f in fields])


def _totals(index: Index, queries: DataFrame, fields: list[str] | None, operator: str) -> tuple[DataFrame, list[str]]:
    """(qid, doc_id, total, matched) of the matches, and the fields: the sum of the
    scores of the fields that match, and these fields as bits in their order."""
    if operator not in (MATCH_ALL, MATCH_ANY):
        raise ValueError(f"operator must be {MATCH_ALL!r} or {MATCH_ANY!r}")
    text, keyword = index.split_fields(fields)
    every = text + keyword
    weighed = weigh_terms(index, query_terms(queries, text, keyword, index.analyzer), operator)
    if len(every) < 64 and 0 < weighed.count() <= BROADCAST_ROWS:
        return _totals_by_document(index, weighed, every, operator), every
    scored = _field_scores(index, weighed, every).where(matched_fields(every, operator))
    bits = [F.when(_matches(f, operator), F.lit(1 << i)).otherwise(0).cast("bigint") for i, f in enumerate(every)]
    matched = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return scored.select("qid", "doc_id", summed_fields(every, operator).alias("total"), matched.alias("matched")), every


def match(index: Index, queries: DataFrame, operator: str = MATCH_ALL, fields: list[str] | None = None) -> DataFrame:
    """(qid, field, doc_id) of documents matching a query in a field: every
    distinct term in that same field for "and", any for "or"; the whole value
    for keyword fields."""
    scored, every = _totals(index, queries, fields, operator)
    has = [F.when(F.col("matched").bitwiseAND(F.lit(1 << i)) != 0, F.lit(f)) for i, f in enumerate(every)]
    matched = F.array_compact(F.array(*has))
    return scored.select("qid", "doc_id", F.explode(matched).alias("field")).select("qid", "field", "doc_id")


def match_keyword(index: Index, queries: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Keyword fields whose value equals the whole query text."""
    return match(index, queries, MATCH_ANY, index.mapping.keyword_fields if fields is None else fields)


def most_fields(
    index: Index,
    queries: DataFrame,
    fields: list[str] | None = None,
    operator: str = MATCH_ALL,
    boost: float = 1.0,
) -> DataFrame:
    """(qid, doc_id, score): the sum of the scores of every field that matches."""
    scored, _ = _totals(index, queries, fields, operator)
    return scored.select("qid", "doc_id", F.round(boost * F.col("total"), 6).alias("score"))


def bm25_field(index: Index, queries: DataFrame, field: str, operator: str = MATCH_ANY) -> DataFrame:
    """(qid, doc_id, score) of one field."""
    return most_fields(index, queries, [field], operator)
