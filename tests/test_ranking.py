import random

from pyspark.sql import functions as F

from siftwood.operators import numbering as nu
from siftwood.operators import ranking as rk


def test_number_rows_with_hot_keys(spark):
    rows = [(0 if i % 3 else i, i) for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, id int").repartition(6)
    got = {r["id"]: r["n"] for r in nu.number_rows(df, ["k", "id"]).collect()}
    assert got == {i: n for n, (k, i) in enumerate(sorted(rows), 1)}


def test_pages_tile_the_order(spark):
    df = spark.range(250).withColumnRenamed("id", "x")
    pages = nu.page_rows(df, [F.desc("x")], 100).collect()
    assert sorted((r["page"], r["n"]) for r in pages) == [((n - 1) // 100 + 1, n) for n in range(1, 251)]
    assert {r["x"] for r in pages if r["page"] == 3} == set(range(50))
    chunks = nu.chunk_rows(df, ["x"], 100).groupBy("chunk").count().collect()
    assert sorted((r["chunk"], r["count"]) for r in chunks) == [(0, 100), (1, 100), (2, 50)]


def test_page_progress(spark):
    rows = nu.page_progress(spark.range(250), 500, 100).orderBy("page").collect()
    assert [(r["posts"], r["read"], r["share"]) for r in rows] == [(100, 100, 0.2), (100, 200, 0.4), (50, 250, 0.5)]
    assert nu.page_progress(spark.range(0), per_page=100).count() == 0
    assert nu.number_rows(spark.range(0), ["id"]).count() == 0


def _scored(spark):
    rows = [(q, f"d{d}", float((d * 7 + q) % 5)) for q in range(3) for d in range(40)]
    return spark.createDataFrame(rows, "qid bigint, doc_id string, score double"), rows


def test_top_k_window_and_deep_agree(spark, monkeypatch):
    df, rows = _scored(spark)
    want = {
        (q, rank, doc)
        for q in range(3)
        for rank, (_, doc) in enumerate(sorted((-s, d) for x, d, s in rows if x == q)[:11], 1)
    }
    take = lambda: {(r["qid"], r["rank"], r["doc_id"]) for r in rk.top_k(df, 11).collect()}
    assert take() == want
    monkeypatch.setattr(rk, "WINDOW_DEPTH", 5)
    assert take() == want


def test_pages_of_hits_tile_the_ranking(spark):
    df, _ = _scored(spark)
    ranked = rk.top_k(df, 40)
    pages = [rk.page_hits(ranked, start, 7) for start in range(0, 42, 7)]
    seen = [(r["qid"], r["rank"]) for p in pages for r in p.collect()]
    assert sorted(seen) == [(q, n) for q in range(3) for n in range(1, 41)]


def test_totals_and_assembly(spark):
    df, _ = _scored(spark)
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (9, "none")], "qid bigint, query string")
    totals = rk.total_hits(df, queries)
    assert {r["qid"]: r["total"] for r in totals.collect()} == {0: 40, 1: 40, 9: 0}
    out = {r["qid"]: r for r in rk.assemble_results(rk.top_k(df, 3), totals, queries).collect()}
    assert [h["rank"] for h in out[0]["hits"]] == [1, 2, 3] and out[9]["hits"] == [] and out[9]["total"] == 0


def test_select_source(spark):
    df, _ = _scored(spark)
    docs = spark.createDataFrame([(f"d{i}", f"t{i}", i) for i in range(40)], "docid string, title string, x int")
    hits = rk.select_source(rk.top_k(df, 2), docs, ["title"])
    assert hits.columns == ["qid", "rank", "doc_id", "score", "title"] and hits.count() == 6
    assert all(r["title"] == "t" + r["doc_id"][1:] for r in hits.collect())
