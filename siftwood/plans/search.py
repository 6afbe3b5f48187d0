"""Batch retrieval: all requests of a table in one plan.

A request row has ``qid, query, topk, from_, size, hybrid, search_fields, vec``.
Without ``hybrid`` the hits are the ``topk`` nearest vectors. With it they are
the documents that match the terms; the ``topk`` nearest of them add their
neighbour score to their BM25 score.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import broadcast_if_small, materialise
from siftwood.functions.vectors import dot, neighbour_score, unit_vector
from siftwood.index import Index
from siftwood.mapping import Mapping
from siftwood.operators.blocks import bm25_top
from siftwood.operators.cells import NPROBE, knn_approx, read_centres
from siftwood.operators.neighbours import knn
from siftwood.operators.ranking import page_hits, select_source, top_k, total_hits
from siftwood.operators.terms import MATCH_ALL, most_fields

# A request's settings where it leaves them out.
REQUEST_DEFAULTS = {"topk": 200, "from_": 0, "size": 10, "hybrid": True}

_HIT_COLUMNS = ["qid", "rank", "doc_id", "score"]


class Results(NamedTuple):
    hits: DataFrame  # qid, rank, doc_id, score: one page per request
    totals: DataFrame | None  # qid, total: hits before paging


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with every column present and typed."""
    have = set(requests.columns)
    setting = lambda c, kind: (
        F.coalesce(F.col(c), F.lit(REQUEST_DEFAULTS[c])) if c in have else F.lit(REQUEST_DEFAULTS[c])
    ).cast(kind).alias(c)
    optional = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return requests.select(
        F.col("qid").cast("bigint").alias("qid"),
        optional("query", "string"),
        setting("topk", "int"),
        setting("from_", "int"),
        setting("size", "int"),
        setting("hybrid", "boolean"),
        optional("search_fields", "array<string>"),
        optional("vec", "array<float>"),
    )


def check_requests(requests: DataFrame, mapping: Mapping) -> DataFrame:
    """(qid, reason) of requests that cannot run."""
    r = with_defaults(requests)
    fields, vec = F.col("search_fields"), F.col("vec")
    no_fields = ~F.col("hybrid") | F.coalesce(F.size(fields) == 0, F.lit(False))
    unknown = F.size(F.array_except(fields, F.array(*map(F.lit, mapping.search_fields)))) > 0
    reason = (
        F.when(vec.isNull() & no_fields, "neither vector nor fields")
        .when(vec.isNotNull() & (F.size(vec) != mapping.dims), "vector width")
        .when(F.col("hybrid") & unknown, "unknown field")
        .when((F.col("topk") < 1) | (F.col("from_") < 0) | (F.col("size") < 0), "bad page")
    )
    return r.select("qid", reason.alias("reason")).where(F.col("reason").isNotNull())


def check_vectors(requests: DataFrame) -> None:
    """One vector per query or none at all."""
    row = requests.agg(F.count("*").alias("queries"), F.count("vec").alias("vectors")).first()
    if 0 < row["vectors"] != row["queries"]:
        raise ValueError("the number of vectors must equal the number of queries")


def _settings(requests: DataFrame) -> DataFrame:
    return broadcast_if_small(requests.select("qid", "topk", "from_", "size"))


def dense_hits(index: Index, requests: DataFrame, k: int, approx: bool = False, nprobe: int = NPROBE) -> DataFrame:
    """Ranked ``topk`` nearest per request; ``k`` bounds every ``topk``. With
    ``approx`` only the ``nprobe`` nearest cells of the index are looked at."""
    if not approx:
        ranked = knn(index.vectors, requests, k)
    elif index.cells is None:
        raise ValueError("the index was built without cells")
    else:
        ranked = knn_approx(index.cells, read_centres(index.centres), index.vectors, requests, k, nprobe)
    return ranked.join(_settings(requests), "qid").where(F.col("rank") <= F.col("topk"))


def term_hits(index: Index, requests: DataFrame, operator: str, boost: float) -> DataFrame:
    """(qid, doc_id, bm25, near): all term matches, with their neighbour score
    where document and request have vectors."""
    matches = most_fields(index, requests, None, operator, boost).withColumnRenamed("score", "bm25")
    queries = requests.select("qid", F.col("vec").alias("query_vec"))
    return (
        # Postings and vectors are bucketed alike by document: no shuffle here.
        matches.join(index.vectors, "doc_id", "left")
        .join(broadcast_if_small(queries, max_rows=20_000), "qid")
        .select("qid", "doc_id", "bm25", neighbour_score(dot(F.col("vec"), F.col("query_vec"))).alias("near"))
    )


def hybrid_hits(matches: DataFrame, requests: DataFrame, k: int, depth: int, boost: float) -> DataFrame:
    """Ranked hits down to ``depth``: BM25 plus the neighbour score of the
    ``topk`` nearest matches.

    A hit outside the nearest ones has its BM25 score only, so it can be among
    the best ``depth`` only if it is among the best ``depth + k`` by BM25. That
    leaves two cuts of the matches, neither of which gathers a whole query.
    """
    near = (
        top_k(matches.where(F.col("near").isNotNull()).withColumn("score", F.col("near")), k)
        .join(_settings(requests), "qid")
        .where(F.col("rank") <= F.col("topk"))
        .select("qid", "doc_id", "bm25", "near")
    )
    lead = top_k(matches.withColumn("score", F.col("bm25")), depth + k)
    both = near.unionByName(lead.select("qid", "doc_id", "bm25", F.lit(None).cast("double").alias("near")))
    summed = both.groupBy("qid", "doc_id").agg(F.max("bm25").alias("bm25"), F.max("near").alias("near"))
    score = F.round(F.col("bm25") + boost * F.coalesce("near", F.lit(0.0)), 6)
    return top_k(summed.select("qid", "doc_id", score.alias("score")), depth)


def batch_search(
    index: Index,
    requests: DataFrame,
    operator: str = MATCH_ALL,
    term_boost: float = 1.0,
    vector_boost: float = 1.0,
    approx: bool = False,
    nprobe: int = NPROBE,
    source: list[str] | None = None,
    vector_field: str | None = None,
) -> Results:
    """Run every request with its own depth, page, fields and kind.

    Vector requests are answered from ``nprobe`` cells each with ``approx``; the
    neighbours among a hybrid request's own matches are always exact. ``source``
    names document fields that hits come with; ``vector_field`` must be the
    index's one vector field."""
    if term_boost < 0 or vector_boost < 0:
        raise ValueError("boosts must not be negative")
    if vector_field not in (None, index.mapping.vector_field):
        raise ValueError(f"unknown vector field: {vector_field!r}")
    unknown = sorted(set(source or []) - set(index.docs.columns))
    if unknown:
        raise ValueError(f"unknown source fields: {unknown}")
    requests = materialise(with_defaults(requests), "requests")
    bad = check_requests(requests, index.mapping).limit(5).collect()
    if bad:
        raise ValueError("bad requests: " + ", ".join(f"{b['qid']}: {b['reason']}" for b in bad))
    requests = requests.withColumn("vec", unit_vector(F.col("vec")).cast("array<float>"))
    # A hybrid request that names no fields is a plain vector request.
    dense_only = ~F.col("hybrid") | F.coalesce(F.size("search_fields") == 0, F.lit(False))
    bounds = requests.select(
        F.max("topk").alias("k"),
        F.max(F.col("from_") + F.col("size")).alias("depth"),
        F.count_if(dense_only).alias("dense"),
        F.count_if(~dense_only).alias("hybrid"),
    ).first()
    parts, counts = [], []
    if bounds["dense"]:
        ranked = materialise(dense_hits(index, requests.where(dense_only), bounds["k"], approx, nprobe), "dense")
        parts.append(ranked.select(_HIT_COLUMNS))
        counts.append(ranked)
    if bounds["hybrid"]:
        asked = requests.where(~dense_only)
        matches = materialise(term_hits(index, asked, operator, term_boost), "matches")
        depth = max(bounds["depth"], 1)
        parts.append(hybrid_hits(matches, asked, bounds["k"], depth, vector_boost).select(_HIT_COLUMNS))
        counts.append(matches)
    if not parts:
        raise ValueError("no requests")
    union = lambda frames, columns: frames[0].select(columns) if len(frames) == 1 else frames[0].select(
        columns
    ).unionByName(frames[1].select(columns))
    pages = page_hits(
        union(parts, _HIT_COLUMNS).join(_settings(requests), "qid"), F.col("from_"), F.col("size")
    ).select(_HIT_COLUMNS)
    if source:
        pages = select_source(pages, index.docs, source, index.mapping.key)
    return Results(pages, total_hits(union(counts, ["qid"]), requests))


def _uniform(queries: DataFrame, **settings) -> DataFrame:
    return queries.withColumns({name: F.lit(value) for name, value in settings.items()})


def search(
    index: Index,
    queries: DataFrame,
    topk: int = 100,
    from_: int = 0,
    size: int = 10,
    hybrid: bool = False,
    search_fields: list[str] | None = None,
    operator: str = MATCH_ALL,
    term_boost: float = 1.0,
    vector_boost: float = 1.0,
    approx: bool = False,
    nprobe: int = NPROBE,
    source: list[str] | None = None,
    vector_field: str | None = None,
) -> Results:
    """One setting for all of ``queries`` (qid, query, vec)."""
    index.split_fields(search_fields)
    if "vec" in queries.columns:
        check_vectors(queries)
    requests = _uniform(queries, topk=topk, from_=from_, size=size, hybrid=hybrid)
    fields = F.array(*map(F.lit, search_fields)) if search_fields else F.lit(None)
    if search_fields == []:
        fields = F.array()
    requests = requests.withColumn("search_fields", fields.cast("array<string>"))
    return batch_search(index, requests, operator, term_boost, vector_boost, approx, nprobe, source, vector_field)


def bm25_search(
    index: Index,
    queries: DataFrame,
    search_fields: list[str] | None = None,
    operator: str = MATCH_ALL,
    from_: int = 0,
    size: int = 10,
    totals: bool = True,
) -> Results:
    """Terms only: page of the best documents, and the number that match. Without
    ``totals`` an index built with blocks reads only blocks that can hold a hit."""
    queries = materialise(queries.select("qid", "query"), "requests")
    if not totals and index.tops is not None:
        ranked, _ = bm25_top(index, queries, max(from_ + size, 1), search_fields, operator)
        return Results(page_hits(ranked, from_, size).select(_HIT_COLUMNS), None)
    matches = materialise(most_fields(index, queries, search_fields, operator), "matches")
    ranked = top_k(matches, max(from_ + size, 1))
    return Results(page_hits(ranked, from_, size).select(_HIT_COLUMNS), total_hits(matches, queries))
