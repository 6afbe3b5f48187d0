"""Publishing, matching and scoring against brute force in Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.mapping import Mapping
from siftwood.operators import blocks
from siftwood.operators import index as ix
from siftwood.operators import ranking
from siftwood.operators import terms
from siftwood.plans import build, search, segments
from siftwood.sinks import index_store as store

MAPPING = Mapping({"vec": "vector", "docid": "keyword", "title": "text", "body": "text", "url": "keyword"}, dims=4)
WORDS = "alpha beta gamma delta epsilon zeta eta theta the the the of of".split()
QUERIES = ["alpha beta", "the", "the of alpha", "alpha alpha beta", "nowhere alpha", "", "d7", "https://x/d9", "the the of"]


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        pick = lambda size: " ".join(rng.choice(WORDS, size)) if size else ""
        vec = rng.normal(size=4) if i % 4 else None
        body = "copy of the alpha" if i % 3 == 0 else pick(int(rng.integers(0, 12)))  # a third are copies
        docs.append((f"d{i}", pick(int(rng.integers(0, 4))), body, f"https://x/d{i}", None if vec is None else [float(np.float32(x)) for x in vec]))
    return docs


DOCS = corpus()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(DOCS, "docid string, title string, body string, url string, vec array<float>")
    root = str(tmp_path_factory.mktemp("index"))
    counts = build.build_index(spark, df, MAPPING, root, "docs", term_buckets=3)
    assert counts["docs"] == 60 and counts["vectors"] == 45
    return build.load_index(spark, root, "docs")


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(9)
    rows = [(i, q, [float(np.float32(x)) for x in rng.normal(size=4)]) for i, q in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "qid bigint, query string, vec array<float>")


def tokens(s):
    return re.findall(r"\w+", (s or "").lower())


def field_terms():
    out = {}
    for doc, title, body, url, _ in DOCS:
        out[doc] = {"title": tokens(title), "body": tokens(body), "docid": [doc], "url": [url]}
    return out


FIELDS = field_terms()


def brute_bm25(query, fields, operator):
    scores = {}
    for f in fields:
        asked = tokens(query) if f in ("title", "body") else ([query] if query else [])
        lens = {d: len(t[f]) for d, t in FIELDS.items() if t[f]}
        avg = sum(lens.values()) / len(lens)
        df = Counter(t for d in lens for t in set(FIELDS[d][f]))
        for d in lens:
            tf = Counter(FIELDS[d][f])
            found = set(asked) & set(tf)
            if not found or (operator == "and" and found != set(asked)):
                continue
            s = 0.0
            for t in asked:
                if tf[t]:
                    idf = math.log(1 + (len(lens) - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * tf[t] * 3 / (tf[t] + 2 * (0.25 + 0.75 * lens[d] / avg))
            scores[d] = scores.get(d, 0.0) + s
    return {d: round(s, 6) for d, s in scores.items()}


def as_scores(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], {})[r["doc_id"]] = r["score"]
    return out


@pytest.mark.parametrize("operator", ["and", "or"])
@pytest.mark.parametrize("fields", [["body"], ["title", "body"], None])
def test_most_fields_matches_brute_force(index, queries, operator, fields):
    got = as_scores(terms.most_fields(index, queries, fields, operator))
    every = fields or ["docid", "title", "body", "url"]
    for qid, q in enumerate(QUERIES):
        want = brute_bm25(q, every, operator)
        assert got.get(qid, {}).keys() == want.keys(), q
        assert all(abs(got[qid][d] - s) < 2e-6 for d, s in want.items()), q


def test_shuffle_path_gives_the_same_scores(index, queries, monkeypatch):
    want = as_scores(terms.most_fields(index, queries, None, "or"))
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    assert as_scores(terms.most_fields(index, queries, None, "or")) == want


def test_and_hits_are_a_subset_of_or_hits(index, queries):
    pairs = lambda op: {tuple(r) for r in terms.match(index, queries, op).collect()}
    assert pairs("and") and pairs("and") < pairs("or")


def test_keyword_match(index, queries):
    hits = {(r["qid"], r["field"], r["doc_id"]) for r in terms.match_keyword(index, queries).collect()}
    assert hits == {(6, "docid", "d7"), (7, "url", "d9")}


def test_unknown_field_and_operator(index, queries):
    with pytest.raises(ValueError, match="unknown search fields"):
        terms.most_fields(index, queries, ["summary"])
    with pytest.raises(ValueError, match="operator"):
        terms.most_fields(index, queries, None, "xor")


def test_scores_are_summed_without_a_shuffle_of_postings(spark, index, queries):
    one = queries.where("qid = 6").select("qid", "query")
    found = terms.most_fields(index, one, ["docid"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    # One query term touches one of the three term buckets.
    assert "PartitionFilters: [isnotnull(tbucket" in plan and found.count() == 1


def _unit(v):
    v = np.array(v, dtype=float)
    return (v / np.linalg.norm(v)).astype(np.float32).astype(float)


def brute_near(vec, docs, k):
    scored = sorted(
        (-round((1 + float(_unit(vec) @ _unit(d[4]))) / 2, 6), d[0]) for d in DOCS if d[4] and d[0] in docs
    )
    return {doc: -s for s, doc in scored[:k]}


def ranked(scores, start, size):
    order = sorted((-s, d) for d, s in scores.items())
    return [(d, n) for n, (_, d) in enumerate(order, 1)][start : start + size]


@pytest.mark.parametrize("hybrid, topk, from_, size", [(False, 10, 2, 5), (True, 3, 0, 8), (True, 100, 4, 6)])
def test_search_matches_brute_force(index, queries, hybrid, topk, from_, size):
    found = search.search(index, queries, topk, from_, size, hybrid, ["title", "body"])
    hits, totals = {}, {r["qid"]: r["total"] for r in found.totals.collect()}
    for r in found.hits.orderBy("qid", "rank").collect():
        hits.setdefault(r["qid"], []).append((r["doc_id"], r["rank"]))
    vecs = {r["qid"]: r["vec"] for r in queries.collect()}
    for qid, q in enumerate(QUERIES):
        if hybrid:
            bm25 = brute_bm25(q, ["title", "body"], "and")
            near = brute_near(vecs[qid], bm25, topk)
            scores = {d: round(s + near.get(d, 0), 6) for d, s in bm25.items()}
        else:
            scores = brute_near(vecs[qid], set(FIELDS), topk)
        assert totals[qid] == len(scores)
        assert hits.get(qid, []) == ranked(scores, from_, size), (q, hybrid)


def test_batch_keeps_each_requests_settings(index, queries):
    rows = queries.withColumns(
        {
            "topk": F.lit(4),
            "from_": (F.col("qid") % 2).cast("int"),
            "size": F.lit(3),
            "hybrid": F.col("qid") % 2 == 0,
            "search_fields": F.array(F.lit("body")),
        }
    )
    batch = {tuple(r) for r in search.batch_search(index, rows).hits.collect()}
    single = set()
    for from_, hybrid in ((0, True), (1, False)):
        part = queries.where(F.col("qid") % 2 == from_)
        single |= {tuple(r) for r in search.search(index, part, 4, from_, 3, hybrid, ["body"]).hits.collect()}
    assert batch == single


def test_hybrid_without_fields_is_dense(index, queries):
    as_rows = lambda r: {tuple(x) for x in r.hits.collect()}
    assert as_rows(search.search(index, queries, hybrid=True, search_fields=[])) == as_rows(search.search(index, queries))


def test_bm25_search_pages_and_totals(index, queries):
    found = search.bm25_search(index, queries, ["body"], from_=1, size=2)
    totals = {r["qid"]: r["total"] for r in found.totals.collect()}
    for qid, q in enumerate(QUERIES):
        want = brute_bm25(q, ["body"], "and")
        got = [(r["doc_id"], r["rank"]) for r in found.hits.where(F.col("qid") == qid).orderBy("rank").collect()]
        assert totals[qid] == len(want) and got == ranked(want, 1, 2)


def test_check_requests(index, spark):
    data = [
        (0, "a", 5, 0, 10, True, None, [1.0] * 4),
        (1, "a", 5, 0, 10, False, None, None),
        (2, "a", 5, 0, 10, True, [], None),
        (3, "a", 5, 0, 10, True, None, [1.0]),
        (4, "a", 5, 0, 10, True, ["nope"], [1.0] * 4),
        (5, "a", 0, 0, 10, True, None, None),
    ]
    schema = "qid bigint, query string, topk int, from_ int, size int, hybrid boolean, search_fields array<string>, vec array<float>"
    df = spark.createDataFrame(data, schema)
    bad = {r["qid"]: r["reason"] for r in search.check_requests(df, MAPPING).collect()}
    assert bad == {
        1: "neither vector nor fields",
        2: "neither vector nor fields",
        3: "vector width",
        4: "unknown field",
        5: "bad page",
    }
    with pytest.raises(ValueError, match="bad requests"):
        search.batch_search(index, df)
    with pytest.raises(ValueError, match="number of vectors"):
        search.check_vectors(df)


def test_publish_repoints_the_alias(spark, tmp_path):
    root = str(tmp_path)
    assert store.open_index(spark, root, "a") is None
    table = lambda n: {"t": spark.range(n).withColumn("part", F.col("id") % 2)}
    layout = {"t": store.Layout("part", "id", ["id"], 2)}
    assert store.publish_index(spark, root, "a", table(5), 1, layout) == {"t": 5}
    store.publish_index(spark, root, "b", table(9), 7)
    assert store.open_index(spark, root, "a")["t"].count() == 5
    store.publish_index(spark, root, "a", table(6), 2)
    assert store.open_index(spark, root, "a")["t"].count() == 6
    assert store.open_index(spark, root, "b")["t"].count() == 9
    assert store.open_index(spark, root, "c") is None
    # An unpublished build stays invisible.
    store.write_tables(store.build_folder(root, "a", 3), table(1), {})
    assert store.open_index(spark, root, "a")["t"].count() == 6


def test_build_refuses_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(None, "t")], "docid string, title string")
    with pytest.raises(Exception, match="docid is required"):
        build.build_index(spark, df, MAPPING, str(tmp_path), "x")


def test_build_refuses_repeated_keys_and_odd_vectors(spark, tmp_path):
    good = [("1", "x", [1.0] * MAPPING.dims), ("2", "y", None)]
    bad = {
        "not unique": ("1", "again", [1.0] * MAPPING.dims),
        "numbers": ("3", "z", [1.0] * (MAPPING.dims + 1)),
        "numbers, as": ("3", "z", [float("nan")] * MAPPING.dims),
    }
    for why, row in bad.items():
        df = spark.createDataFrame([*good, row], "docid string, title string, vec array<float>")
        with pytest.raises(ValueError, match=why):
            build.build_index(spark, df, MAPPING, str(tmp_path), "odd")
        assert build.load_index(spark, str(tmp_path), "odd") is None


def test_few_terms_reach_the_scan(spark, index):
    one = spark.createDataFrame([(1, "alpha")], "qid bigint, query string")
    plan = terms.match(index, one, "or")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: .*EqualTo\(term,alpha\)", plan)


def test_index_tables_count_terms(spark):
    df = spark.createDataFrame([("1", "a b a", "x"), ("2", "", None), ("3", "b", "x")], "docid string, body string, tag string")
    posts = ix.postings(df, ["body"])
    assert {tuple(r) for r in posts.collect()} == {("body", "a", "1", 2), ("body", "b", "1", 1), ("body", "b", "3", 1)}
    assert {tuple(r) for r in ix.doc_lengths(posts).collect()} == {("body", "1", 3), ("body", "3", 1)}
    assert {tuple(r) for r in ix.doc_freqs(posts).collect()} == {("body", "a", 1), ("body", "b", 2)}
    assert tuple(ix.field_stats(ix.doc_lengths(posts)).first()) == ("body", 2, 2.0, 4)
    assert {tuple(r) for r in ix.keyword_terms(df, ["tag"]).collect()} == {("tag", "x", "1"), ("tag", "x", "3")}


def test_approximate_search_through_the_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 8)).astype(np.float32)
    points[::3] = points[0]  # a third are copies
    rows = [(f"d{i}", "word", "some words", f"u{i}", [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "docid string, title string, body string, url string, vec array<float>")
    mapping = Mapping(MAPPING.fields, dims=8)
    build.build_index(spark, df, mapping, str(tmp_path), "a", cells=12)
    index = build.load_index(spark, str(tmp_path), "a")
    asked = df.where("substr(docid, 2) % 3 = 1").select(F.expr("substr(docid, 2)").cast("bigint").alias("qid"), "vec")
    requests = asked.withColumns({"hybrid": F.lit(False), "topk": (F.col("qid") % 7 + 5).cast("int"), "size": F.lit(10)})
    exact, near, full = (
        {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in search.batch_search(index, requests, **how).hits.collect()}
        for how in ({}, {"approx": True, "nprobe": 6}, {"approx": True, "nprobe": 12})
    )
    found = lambda hits: {(q, d) for (q, _), (d, _) in hits.items()}
    assert len(found(exact) & found(near)) / len(exact) >= 0.9
    assert len(found(exact) & found(full)) / len(exact) >= 0.99
    assert search.search(index, asked, approx=True, topk=4, size=3).hits.count() == 3 * asked.count()


def test_search_arguments_for_source_and_vector_field(index, queries):
    hits = search.search(index, queries, size=3, source=["title", "url"], vector_field="vec").hits
    assert hits.columns == ["qid", "rank", "doc_id", "score", "title", "url"]
    plain = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in search.search(index, queries, size=3).hits.collect()}
    by_id = {d[0]: d for d in DOCS}
    rows = hits.collect()
    assert {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in rows} == plain
    assert all((r["title"], r["url"]) == (by_id[r["doc_id"]][1], by_id[r["doc_id"]][3]) for r in rows)
    for bad in ({"source": ["nothing"]}, {"vector_field": "title"}, {"approx": True}):
        with pytest.raises(ValueError):
            search.search(index, queries, **bad)


def test_and_reads_the_rarest_term_first(spark, tmp_path):
    """A term in every document adds no more rows than the rarest term has."""
    rows = [(f"d{i}", "", "every document says common words" + (" seldom" if i % 50 == 0 else ""), None, None) for i in range(500)]
    df = spark.createDataFrame(rows, "docid string, title string, body string, url string, vec array<float>")
    build.build_index(spark, df, MAPPING, str(tmp_path), "r", term_buckets=3)
    index = build.load_index(spark, str(tmp_path), "r")
    asked = spark.createDataFrame([(1, "common seldom words"), (2, "seldom"), (3, "common nowhere"), (4, "every common")], "qid bigint, query string")
    weighed = terms.weigh_terms(index, terms.query_terms(asked, ["body"], [], index.analyzer), "and")
    rows = {r["qid"]: r["count"] for r in terms.rarest_first(index, weighed).groupBy("qid").count().collect()}
    assert rows == {1: 3 * 10, 2: 10, 4: 2 * 500}
    hits = as_scores(terms.most_fields(index, asked, ["body"], "and"))
    assert {q: len(d) for q, d in hits.items()} == {1: 10, 2: 10, 4: 500}
    terms_or = as_scores(terms.most_fields(index, asked, ["body"], "or"))
    assert all(terms_or[1][d] == s for d, s in hits[1].items())


def test_and_without_a_broadcast_of_the_rarest(index, queries, monkeypatch):
    want = as_scores(terms.most_fields(index, queries, None, "and"))
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    assert as_scores(terms.most_fields(index, queries, None, "and")) == want


@pytest.fixture(scope="module")
def blocked(spark, tmp_path_factory):
    """Documents of very different lengths, a third of them copies."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        n = int(rng.choice([2, 4, 8, 30, 120, 300]))
        body = "w1 w2 copies of one text" if i % 3 == 0 else " ".join(rng.choice(words[: 20 if i % 5 else 200], n))
        rows.append((f"d{i}", " ".join(rng.choice(words, 2)) if i % 2 else "", body, f"u{i}", None))
    df = spark.createDataFrame(rows, "docid string, title string, body string, url string, vec array<float>")
    root = str(tmp_path_factory.mktemp("blocked"))
    build.build_index(spark, df, MAPPING, root, "b", term_buckets=3, block_docs=8)
    asked = ["w1", "w1 w2 w3", "w150 w3", "w9 w9 w12 w4 w180", "nowhere", "", "u7", "w7 nowhere"]
    return build.load_index(spark, root, "b"), spark.createDataFrame(list(enumerate(asked)), "qid bigint, query string")


def as_hits(df):
    return {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("operator", ["and", "or"])
@pytest.mark.parametrize("fields", [["body"], None])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_block_max_gives_the_hits_of_a_full_search(blocked, operator, fields, k):
    index, asked = blocked
    want = as_hits(ranking.top_k(terms.most_fields(index, asked, fields, operator), k))
    hits, _ = blocks.bm25_top(index, asked, k, fields, operator)
    assert as_hits(hits) == want


def test_block_max_reads_few_blocks(spark, blocked):
    index, _ = blocked
    asked = spark.createDataFrame([(1, "w1"), (2, "w3 w5"), (3, "w11 w12 w13")], "qid bigint, query string")
    weighed = terms.weigh_terms(index, terms.query_terms(asked, ["body"], [], index.analyzer), "or")
    every = {r["qid"]: r["count"] for r in blocks.block_bounds(index, weighed, ["body"], "or").groupBy("qid").count().collect()}
    hits, read = blocks.bm25_top(index, asked, 5, ["body"], "or")
    few = {r["qid"]: r["count"] for r in read.groupBy("qid").count().collect()}
    assert read.count() == read.distinct().count()
    assert all(few[q] < 0.7 * every[q] for q in every) and sum(few.values()) < sum(every.values()) / 2, (few, every)
    assert as_hits(hits) == as_hits(ranking.top_k(terms.most_fields(index, asked, ["body"], "or"), 5))


def test_search_without_totals(blocked, index, queries):
    built, asked = blocked
    for from_ in (0, 3):
        fast = search.bm25_search(built, asked, ["title", "body"], "or", from_, 4, totals=False)
        assert fast.totals is None
        assert as_hits(fast.hits) == as_hits(search.bm25_search(built, asked, ["title", "body"], "or", from_, 4).hits)
    assert search.bm25_search(index, queries, totals=False).totals is not None, "an index without blocks counts as well"
    with pytest.raises(ValueError):
        blocks.bm25_top(index, queries, 3)


def test_search_over_segments_equals_one_build(spark, index, queries, tmp_path):
    schema = "docid string, title string, body string, url string, vec array<float>"
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    stale = [(d, "stale words", "the the alpha of", u, v) for d, _, _, u, v in DOCS[:40]]
    with pytest.raises(ValueError):
        segments.add_segment(spark, frame(DOCS[:1]), root, "s")
    build.build_index(spark, frame(stale), MAPPING, root, "s", term_buckets=3)
    segments.add_segment(spark, frame(DOCS[:30]), root, "s")
    before = build.load_index(spark, root, "s")
    names = segments.add_segment(spark, frame(DOCS[20:]), root, "s")
    assert len(names) == 3 and before.docs.count() == 40 and {r["title"] for r in before.docs.collect()} >= {"stale words"}

    def same(found):
        for table in ("docs", "vectors", "lengths", "stats"):
            one, many = getattr(index, table), getattr(found, table)
            assert sorted(map(repr, many.select(sorted(many.columns)).collect())) == sorted(map(repr, one.select(sorted(many.columns)).collect())), table
        for operator in ("and", "or"):
            assert as_scores(terms.most_fields(found, queries, None, operator)) == as_scores(terms.most_fields(index, queries, None, operator))
        for how in ({"hybrid": True}, {}):
            one, many = (search.search(i, queries, topk=9, **how) for i in (index, found))
            assert as_hits(many.hits) == as_hits(one.hits)
            assert sorted(map(tuple, many.totals.collect())) == sorted(map(tuple, one.totals.collect()))

    same(build.load_index(spark, root, "s"))
    # The newest two become one, then all.
    assert len(segments.merge_segments(spark, root, "s", 1)) == 2
    same(build.load_index(spark, root, "s"))
    assert len(segments.merge_segments(spark, root, "s")) == 1 and len(segments.merge_segments(spark, root, "s")) == 1
    same(build.load_index(spark, root, "s"))
    assert before.docs.count() == 40
