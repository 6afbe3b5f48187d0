"""Scores and best hits held by what a task reads, not by pairs of requests and documents."""

import math
import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood import fixtures
from siftwood.cluster import materialise
from siftwood.functions import encoders
from siftwood.mapping import Mapping
from siftwood.operators import blocks, ranking, terms
from siftwood.plans import build
from siftwood.sinks import index_store


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"d{i}", f"w{i % 3}", " ".join(f"w{j}" for j in range(i % 7)) + " the the", None) for i in range(80)]
    df = spark.createDataFrame(rows, "docid string, title string, body string, url string")
    root = str(tmp_path_factory.mktemp("bounded"))
    mapping = Mapping({"docid": "keyword", "title": "text", "body": "text", "url": "keyword"}, dims=None)
    build.build_index(spark, df, mapping, root, "b", term_buckets=3)
    return build.load_index(spark, root, "b")


@pytest.mark.parametrize("operator", ["and", "or"])
def test_pairs_are_summed_by_document(spark, index, monkeypatch, operator):
    asked = [(1, "the w1"), (2, "w1 w2 w1"), (None, "the"), (4, "nowhere the"), (5, ""), (6, "d7"), (7, "w0 w1 w2 w3 w4 w5 the"), (8, "nowhere")]
    asked = spark.createDataFrame(asked, "qid bigint, query string")
    found = lambda: [
        sorted(map(repr, df.collect())) for df in (terms.most_fields(index, asked, None, operator), terms.match(index, asked, operator))
    ]
    plan = terms.most_fields(index, asked, None, operator)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "keys=[qid" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    whole = found()
    monkeypatch.setattr(terms, "HELD_PAIRS", 3)
    assert found() == whole
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    assert found() == whole and all(whole)


@pytest.mark.parametrize("held", [5, 100, 1 << 20])
def test_tasks_cut_their_hits_to_the_best(spark, monkeypatch, held):
    score = lambda i: None if i % 31 == 0 else math.nan if i % 37 == 0 else float(i * 7 % 11)
    rows = [(None if i % 41 == 0 else i % 4, None if i % 43 == 0 else f"é{i % 50}" if i % 2 else f"z{i}", score(i), i) for i in range(900)]
    scored = spark.createDataFrame(rows, "qid bigint, doc_id string, score double, more int").repartition(3)
    best = [F.desc("score"), F.asc("doc_id")]
    want = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*best))).where("rank <= 6")
    monkeypatch.setattr(ranking, "HELD_ROWS", held)
    got = ranking.top_k(scored, 6)
    assert got.columns == want.columns
    key = lambda df: sorted(map(repr, df.select("qid", "doc_id", "score", "rank").collect()))
    assert key(got) == key(want)


def test_little_of_many_hits_leaves_a_task(spark):
    scored = spark.range(0, 200_000, 1, 4).selectExpr("id % 5 qid", "cast(id as string) doc_id", "cast(1 as double) score")
    cut = scored.mapInArrow(ranking._best_of_task(10, 5000), scored.schema)
    assert cut.count() == 4 * 5 * 10
    assert "MapInArrow" in ranking.top_k(scored, 10)._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_documents_not_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert build.buckets_for(spark, 10) == cores
    assert all(n / build.buckets_for(spark, n) <= 10_000 for n in (250_000, 1_800_000))


@pytest.mark.parametrize("operator", ["and", "or"])
def test_blocks_are_scored_without_pairs_of_postings_and_requests(spark, tmp_path_factory, monkeypatch, operator):
    rows = [(f"d{i}", f"w{i % 3}", " ".join(f"w{j}" for j in range(i % 7)) + " the" * (i % 5), None) for i in range(120)]
    df = spark.createDataFrame(rows, "docid string, title string, body string, url string")
    root = str(tmp_path_factory.mktemp("blocks"))
    mapping = Mapping({"docid": "keyword", "title": "text", "body": "text", "url": "keyword"}, dims=None)
    build.build_index(spark, df, mapping, root, "b", term_buckets=3, block_docs=8)
    index = build.load_index(spark, root, "b")
    asked = [(1, "the w1"), (2, "w1 w2 w1"), (4, "nowhere the"), (5, ""), (6, "d7"), (7, "w0 w1 w2 w3 w4 w5 the"), (8, "nowhere")]
    asked = spark.createDataFrame(asked, "qid bigint, query string")
    built, written = [], blocks.materialise
    monkeypatch.setattr(blocks, "materialise", lambda df, label: built.append((label, df)) or written(df, label))
    found = lambda: sorted(map(repr, blocks.bm25_top(index, asked, 3, None, operator)[0].collect()))
    whole = found()
    plans = [df._jdf.queryExecution().executedPlan().toString() for label, df in built if label in ("bounds", "begun")]
    assert len(plans) == 2 and all("MapInArrow" in p and "keys=[qid" not in p for p in plans)
    monkeypatch.setattr(terms, "HELD_PAIRS", 3)
    assert found() == whole
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 0)
    assert found() == whole and whole


@pytest.mark.parametrize("buckets", [3, 9])  # below and above the usual number of partitions
def test_placed_documents_are_encoded_paired_and_built_without_a_shuffle(spark, tmp_path_factory, monkeypatch, buckets):
    rows = [(f"d{i}", f"w{i % 3}", "the w1" if i % 2 else "") for i in range(40)]
    docs = build.place_docs(spark.createDataFrame(rows, "docid string, title string, body string"), buckets)
    vecs = encoders.encode(docs, "docid", F.col("body")).withColumnRenamed("docid", "doc_id")
    written, write = {}, build.write_tables
    monkeypatch.setattr(build, "write_tables", lambda folder, new, layouts: written.update(new) or write(folder, new, layouts))
    root = str(tmp_path_factory.mktemp("placed"))
    mapping = Mapping({"docid": "keyword", "title": "text", "body": "text", "vec": "vector"}, dims=64)
    build.build_index(spark, build.attach_vectors(docs, vecs), mapping, root, "p", term_buckets=2, doc_buckets=buckets, placed=True)
    plan = written["docs"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    got = sorted((r["docid"], r["title"], r["body"]) for r in build.load_index(spark, root, "p").docs.collect())
    assert got == sorted(rows)
    assert {r["docid"] for r in build.load_index(spark, root, "p").docs.where("vec IS NOT NULL").collect()} == {r[0] for r in rows if r[2]}


def test_a_build_still_refuses_rows_without_key(spark, tmp_path_factory):
    docs = build.place_docs(spark.createDataFrame([("d1", "a"), (None, "b")], "docid string, body string"), 2)
    with pytest.raises(Exception, match="docid is required"):
        build.build_index(spark, docs, Mapping({"docid": "keyword", "body": "text"}), str(tmp_path_factory.mktemp("nokey")), "n")


def test_scratch_and_index_tables_are_written_small(spark, tmp_path):
    folders = {"index": str(tmp_path / "plain"), "scratch": materialise(spark.range(9), "small").inputFiles()[0].rsplit("/", 1)[0]}
    index_store.write_table(spark.range(9), folders["index"], index_store.Layout())
    for folder in folders.values():
        files = [f for f in os.listdir(folder.removeprefix("file://")) if f.endswith(".parquet")]
        assert files and all(".zstd." in f for f in files)


def test_posts_without_bodies_shuffle_no_text(spark, sf):
    titles = fixtures.posts(spark, sf).select("number", "full_name")
    below = titles._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "substring_index(text" in below
    want = fixtures.posts(spark, sf).select("number", F.substring_index("body_md", ".", 1).alias("full_name"))
    assert sorted(map(tuple, titles.collect())) == sorted(map(tuple, want.collect()))
