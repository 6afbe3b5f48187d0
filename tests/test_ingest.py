import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from siftwood.cluster import scratch_root
from siftwood.mapping import Mapping
from siftwood.operators import ingest, projections
from siftwood.plans import collect
from siftwood.sinks import bucket_store
from siftwood.sinks.files import write_jsonl
from siftwood.sources import readers
from siftwood.streaming import feeds

MAPPING = Mapping({"vec": "vector", "docid": "keyword", "title": "text"}, dims=2)
POST = "number string, full_name string, arrival int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_last_arrival_wins(spark):
    target = spark.createDataFrame([("1", "old"), ("2", "keep")], "number string, full_name string")
    changes = spark.createDataFrame([("1", "b", 2), ("1", "a", 1), ("3", "new", 3)], POST)
    once = ingest.upsert_posts(target, changes)
    assert rows(once) == [("1", "b"), ("2", "keep"), ("3", "new")]
    assert rows(ingest.upsert_posts(once, changes)) == rows(once)
    # Two batches equal one, in any row order.
    first, second = changes.where("arrival < 2"), changes.where("arrival >= 2")
    assert rows(ingest.upsert_posts(ingest.upsert_posts(target, first), second)) == rows(once)
    assert rows(ingest.upsert_posts(target, changes.orderBy(F.desc("arrival")))) == rows(once)


def test_upsert_keeps_columns_the_changes_lack(spark):
    target = spark.createDataFrame([("1", "old", "n1"), ("2", "x", "n2")], "number string, full_name string, name string")
    changes = spark.createDataFrame([("1", "b", 2), ("3", "c", 3)], POST)
    assert sorted(map(str, rows(ingest.upsert_posts(target, changes)))) == sorted(
        map(str, [("1", "b", "n1"), ("2", "x", "n2"), ("3", "c", None)])
    )


@pytest.mark.parametrize(
    "log, since",
    [
        ([], None),
        ([(1, "2024-01-01", "2024-01-01", "success"), (2, "2024-01-05", "2024-01-04", "success")], "2024-01-05"),
        ([(1, "2024-01-01", "2024-01-01", "success"), (2, "2024-01-05", "2024-01-04", "error: (x)")], None),
        ([(2, "2024-01-05", "2024-01-04", "success"), (1, "2024-01-09", None, "error: (x)")], "2024-01-05"),
    ],
)
def test_incremental_scan(spark, log, since):
    run_log = spark.createDataFrame(log, ingest.RUN_LOG)
    assert ingest.read_since(run_log) == since
    days = [dt.datetime(2024, 1, d, 0, 0) for d in (4, 5, 6)]
    posts = spark.createDataFrame([(d,) for d in days], "updated_at timestamp")
    assert ingest.incremental_scan(posts, run_log).count() == (3 if since is None else 2)


def test_incremental_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "posts")
    spark.createDataFrame([(dt.datetime(2024, 1, 1), "a")], "updated_at timestamp, t string").write.parquet(path)
    log = spark.createDataFrame([(1, "2024-01-01", None, "success")], ingest.RUN_LOG)
    plan = ingest.incremental_scan(spark.read.parquet(path), log)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(updated_at" in plan


def test_run_log_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (3, 7)], "updated_at timestamp")
    for no, status in ((1, "success"), (2, "error: (x)")):
        ingest.append_run(ingest.record_run(posts, f"2024-01-1{no}", status, no), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert rows(log) == [(1, "2024-01-11", "2024-01-07", "success"), (2, "2024-01-12", "2024-01-07", "error: (x)")]
    assert ingest.record_run(posts.where("false"), "2024-01-11", "success").first()["last_updated_at"] is None


def test_read_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"doc_id": "1", "text": "日本", "title": "t"}\n{"doc_id": "2", "text": "x"}\n', encoding="utf-8")
    docs = projections.conform_docs(readers.read_jsonl(spark, str(good)))
    assert rows(docs) == [("1", "日本", "t"), ("2", "x", "")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"doc_id": "1", "text": "x"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_jsonl(spark, str(bad)).collect()


def test_write_jsonl_keeps_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", "日本", None)], "a string, b string, c string")
    write_jsonl(df.coalesce(1), str(tmp_path / "out"))
    [line] = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")]
    assert line == '{"a":"1","b":"日本","c":null}\n'


def test_conform_docs_requires_key_and_text(spark):
    for bad in [(None, "x"), ("1", None)]:
        with pytest.raises(Exception, match="is required"):
            projections.conform_docs(spark.createDataFrame([bad], "doc_id string, text string")).collect()


def test_read_table(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert readers.read_table(spark, "three").count() == 3
    with pytest.raises(ValueError):
        readers.read_table(spark, "t", {"url": "jdbc:x", "partitionColumn": "id"})


def test_feed_pages(spark, tmp_path):
    page = (
        '{"page": %d, "posts": [{"number": "%s", "full_name": "a", "wip": false, "body_md": "b", "body_html": null, '
        '"created_at": "2024-01-01T09:00:00+09:00", "updated_at": "2024-01-02T00:00:00+00:00", "url": "u", '
        '"created_by": {"screen_name": "me"}}], "next_page": null}\n'
    )
    (tmp_path / "p1.json").write_text(page % (1, "7") + '{"page": 2, "posts": [], "next_page": null}\n')
    posts = projections.flatten_posts(readers.read_feed_pages(spark, str(tmp_path)))
    [row] = posts.collect()
    assert (row["page"], row["pos"], row["number"], row["created_by"]) == (1, 0, "7", "me")
    assert row["created_at"] == dt.datetime(2024, 1, 1)


def _feed(folder, name, page, numbers, stamp):
    posts = ",".join(
        f'{{"number":"{n}","full_name":"{name}-{n}","wip":false,"body_md":"b","updated_at":"2024-01-0{stamp}T00:00:00Z",'
        f'"created_at":"2024-01-01T00:00:00Z","url":"u","created_by":{{"screen_name":"me"}}}}'
        for n in numbers
    )
    (folder / f"{name}.json").write_text(f'{{"page":{page},"posts":[{posts}],"next_page":null}}\n')


def test_stream_upsert_resumes_and_equals_batch(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    target = projections.conform_posts(spark.createDataFrame([("1", "old"), ("9", "keep")], "number string, full_name string"))
    run = lambda: feeds.stream_upsert(
        spark, str(feed), str(tmp_path / "log"), str(tmp_path / "ckpt"), 1
    ).awaitTermination()
    _feed(feed, "a", 1, [1, 2], 1)
    _feed(feed, "b", 2, [2, 3], 2)
    run()
    _feed(feed, "c", 3, [3, 1], 3)
    run()
    run()  # nothing new
    merged = feeds.merged_posts(target, str(tmp_path / "log"))
    batch = ingest.upsert_posts(
        target, projections.flatten_posts(readers.read_feed_pages(spark, str(feed))), order_by=feeds.ARRIVAL
    )
    names = lambda df: rows(df.select("number", "full_name"))
    assert names(merged) == names(batch) == [("1", "c-1"), ("2", "b-2"), ("3", "c-3"), ("9", "keep")]
    # A replayed batch overwrites its own folder.
    spark_batch = spark.read.parquet(str(tmp_path / "log")).where("batch = 0").drop("batch")
    feeds.change_writer(str(tmp_path / "log"))(spark_batch.cache(), 0)
    assert names(feeds.merged_posts(target, str(tmp_path / "log"))) == names(batch)
    assert names(feeds.merged_posts(batch, str(tmp_path / "log"), after=2)) == names(batch)


def test_later_crawl_wins_over_later_page(spark, tmp_path):
    target = projections.conform_posts(spark.createDataFrame([("9", "keep")], "number string, full_name string"))
    names = lambda log: rows(feeds.merged_posts(target, str(log)).select("number", "full_name"))
    run = lambda feed, log, n: feeds.stream_upsert(spark, str(feed), str(log), f"{log}-ckpt", n).awaitTermination()
    for n in (1, 10):  # a batch per file, and one batch
        feed = tmp_path / f"named{n}"
        for crawl, label, page, ids, day in [("1", "old", 7, [1, 2], 2), ("2", "new", 1, [1, 3], 5)]:
            (feed / f"crawl={crawl}").mkdir(parents=True)
            _feed(feed / f"crawl={crawl}", label, page, ids, day)
        run(feed, tmp_path / f"log{n}", n)
        assert names(tmp_path / f"log{n}") == [("1", "new-1"), ("2", "old-2"), ("3", "new-3"), ("9", "keep")]
    flat = tmp_path / "flat"
    flat.mkdir()
    _feed(flat, "old", 7, [1], 2)
    run(flat, tmp_path / "logf", 1)
    _feed(flat, "new", 1, [1], 5)
    run(flat, tmp_path / "logf", 1)
    assert names(tmp_path / "logf") == [("1", "new-1"), ("9", "keep")]


def test_empty_feed_is_a_good_run(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    feeds.stream_upsert(spark, str(tmp_path / "feed"), str(tmp_path / "log"), str(tmp_path / "ck"), 1).awaitTermination()
    target = projections.conform_posts(spark.createDataFrame([("9", "keep")], "number string, full_name string"))
    assert rows(feeds.merged_posts(target, str(tmp_path / "log")).select("number")) == [("9",)]


def test_failed_run_is_logged_and_followed_by_a_full_read(spark, tmp_path):
    feed, log = tmp_path / "feed", str(tmp_path / "runs")
    feed.mkdir()
    target = projections.conform_posts(spark.createDataFrame([("9", "keep")], "number string, full_name string"))
    _feed(feed, "a", 1, [1, 2], 1)
    merged = collect.collect(spark, str(feed), target, log, "2024-01-03")
    assert rows(merged.select("number")) == [("1",), ("2",), ("9",)]
    (feed / "broken.json").write_text("no json")
    with pytest.raises(Exception):
        collect.collect(spark, str(feed), merged, log, "2024-01-04")
    (feed / "broken.json").unlink()
    again = collect.collect(spark, str(feed), target, log, "2024-01-05")
    assert rows(again.select("number")) == [("1",), ("2",), ("9",)]
    assert [r[1:] for r in rows(collect.read_run_log(spark, log).select("run_no", "executed_at", "exit_status"))] == [
        ("2024-01-03", "success"), ("2024-01-04", "error"), ("2024-01-05", "success")
    ]
    late = collect.collect(spark, str(feed), target, log, "2024-01-06")  # nothing is as new as the last run
    assert rows(late.select("number")) == [("9",)]


def test_stream_dedupe_passes_once(spark, tmp_path):
    schema = "number string, updated_at timestamp"
    stamps = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    for batch in ([0, 1], [1, 2], [2, 2]):
        df = spark.createDataFrame([("1", stamps[i]) for i in batch], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        feeds.stream_dedupe(stream, ["number", "updated_at"], "31 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert [r[1] for r in rows(spark.read.parquet(str(tmp_path / "out")))] == stamps


def test_map_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = projections.map_columns(df, {"a": "b", "zz": "y", "c": "a"})
    assert out.columns == ["b", "a"] and tuple(out.first()) == (1, 3)


def test_index_fields_nulls_extra_and_missing(spark):
    df = spark.createDataFrame([("1", "raw")], "docid string, body_raw string")
    out = projections.index_fields(df, MAPPING)
    assert out.columns == ["vec", "docid", "title"] and tuple(out.first()) == (None, "1", None)


def test_conform_posts_checks(spark):
    make = lambda values: spark.createDataFrame(values, "number string, created_by string")
    assert projections.conform_posts(make([("1", "me")])).columns == list(projections.POST_COLUMNS)
    with pytest.raises(ValueError, match="not unique"):
        projections.conform_posts(make([("1", "a"), ("1", "b")]))
    for bad, why in [((None, "a"), "required"), (("12345678901", "a"), "longer"), (("1", "x" * 21), "longer")]:
        with pytest.raises(Exception, match=why):
            projections.conform_posts(make([bad])).collect()


def test_validate_records(spark):
    data = [
        ("1", [1.0, 0.0]),
        ("2", None),
        (None, [1.0, 0.0]),
        ("4", [1.0]),
        ("5", [0.0, 0.0]),
        ("6", [float("nan"), 1.0]),
        ("", [1.0]),
    ]
    checked = projections.validate_records(spark.createDataFrame(data, "docid string, vec array<float>"), MAPPING)
    reasons = [r["reasons"] for r in checked.collect()]
    assert reasons == [[], [], ["missing key"], ["vector width"], ["zero vector"], ["vector value"], ["missing key", "vector width"]]
    assert tuple(projections.count_records(checked).first()) == (2, 5)
    assert projections.accepted(checked).count() == 2 and projections.rejected(checked).count() == 5


def test_search_requests(spark):
    urls = [
        "/search?query=caf%C3%A9+noir&topk=7&hybrid=0&from=20&size=5&search_fields=title,body",
        "/search?query=x",
        "/search?topk=abc&search_fields=",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "qid bigint, url string")
    got = [tuple(r)[1:] for r in projections.search_requests(df, "url").orderBy("qid").collect()]
    assert got == [
        ("café noir", 7, 20, 5, False, ["title", "body"]),
        ("x", 200, 0, 10, True, None),
        ("", 200, 0, 10, True, None),
    ]


# --- bucket stores ------------------------------------------------------------------


def numbered(spark, n, text="old"):
    return spark.createDataFrame([(str(i), f"{text} {i}") for i in range(n)], "number string, full_name string")


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    root = str(tmp_path / "store")
    first = bucket_store.create_store(numbered(spark, 200), root, "number", 8)
    assert len(first.folders) == 8
    second = bucket_store.merge_store(spark, root, spark.createDataFrame([("7", "new", 1)], POST), ["arrival"])
    changed = {b for b in first.folders if first.folders[b] != second.folders[b]}
    assert len(changed) == 1 and [p.name for p in (tmp_path / "store" / "data" / f"v={second.version}").glob("_bucket=*")] == [f"_bucket={b}" for b in changed]
    # A reader of the old version still sees it whole.
    old = bucket_store.open_store(spark, root, first.version)
    assert rows(first.read(spark)) == rows(old.read(spark)) == rows(numbered(spark, 200))
    assert rows(bucket_store.open_store(spark, root).read(spark)) == sorted([(str(i), "new" if i == 7 else f"old {i}") for i in range(200)])


def test_merges_equal_one_upsert_of_all(spark, tmp_path):
    root = str(tmp_path / "store")
    target = numbered(spark, 50)
    bucket_store.create_store(target, root, "number", 5)
    changes = spark.createDataFrame([(str(i % 70), f"change {i}", i) for i in range(300)], POST)
    for low, high in ((0, 100), (100, 220), (220, 300)):
        bucket_store.merge_store(spark, root, changes.where(f"arrival >= {low} AND arrival < {high}"), ["arrival"])
    assert rows(bucket_store.open_store(spark, root).read(spark)) == rows(ingest.upsert_posts(target, changes))
    # Columns that changes lack, new buckets, and an empty store.
    empty = bucket_store.create_store(target.limit(0), str(tmp_path / "empty"), "number", 4)
    assert empty.read(spark).count() == 0
    merged = bucket_store.merge_store(spark, str(tmp_path / "empty"), changes.where("arrival < 3").drop("full_name"), ["arrival"])
    assert rows(merged.read(spark)) == [("0", None), ("1", None), ("2", None)]


def test_a_run_into_a_store_finds_last_changes_once(spark, tmp_path):
    feed, root = tmp_path / "feed", str(tmp_path / "store")
    feed.mkdir()
    _feed(feed, "a", 1, [1, 2], 2)
    _feed(feed, "b", 2, [2, 3], 3)
    target = projections.conform_posts(spark.createDataFrame([("2", "old"), ("9", "keep")], "number string, full_name string"))
    bucket_store.create_store(target, root, "number", 3)
    written = lambda: set(glob.glob(f"{scratch_root(spark)}/changes-*"))
    before = written()
    merged = collect.collect_into(spark, str(feed), root, str(tmp_path / "log"), "2024-01-03")
    assert len(written() - before) == 1
    want = collect.collect(spark, str(feed), target, str(tmp_path / "other"), "2024-01-03")
    assert rows(merged.read(spark).select(want.columns)) == rows(want)


def test_merges_refuse_what_is_not_there_and_what_came_between(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    change = spark.createDataFrame([("1", "x", 1)], POST)
    assert bucket_store.open_store(spark, root) is None
    with pytest.raises(ValueError):
        bucket_store.merge_store(spark, root, change, ["arrival"])
    first = bucket_store.create_store(numbered(spark, 5), root, "number", 2)
    with pytest.raises(ValueError):
        bucket_store.create_store(numbered(spark, 5), root, "number", 2)
    assert bucket_store.merge_store(spark, root, change.limit(0), ["arrival"]).version == first.version
    write = bucket_store._write

    def slow(*args):
        monkeypatch.setattr(bucket_store, "_write", write)
        bucket_store.merge_store(spark, root, spark.createDataFrame([("2", "between", 1)], POST), ["arrival"])
        return write(*args)

    monkeypatch.setattr(bucket_store, "_write", slow)
    with pytest.raises(RuntimeError):
        bucket_store.merge_store(spark, root, change, ["arrival"])
    assert ("2", "between") in rows(bucket_store.open_store(spark, root).read(spark))


def test_stream_changes_merge_once_into_a_store(spark, tmp_path):
    root, log = str(tmp_path / "store"), str(tmp_path / "log")
    change = "crawl string, arrived timestamp, page int, pos int, number string, full_name string, batch int"
    batches = [("2024", None, 1, 0, "1", "first", 0), ("2024", None, 1, 1, "2", "first", 0), ("2025", None, 1, 0, "1", "second", 1)]
    bucket_store.create_store(numbered(spark, 4), root, "number", 3)
    for last in (0, 1):
        spark.createDataFrame([b for b in batches if b[6] == last], change).write.mode("append").partitionBy("batch").parquet(log)
        merged = feeds.merge_changes(spark, root, log)
        assert merged.notes == {"batch": last} and feeds.merge_changes(spark, root, log).version == merged.version
    assert rows(merged.read(spark)) == [("0", "old 0"), ("1", "second"), ("2", "first"), ("3", "old 3")]


def test_stream_dedupe_once_outlives_restarts_and_late_repeats(spark, tmp_path):
    schema = "number string, updated_at timestamp, v int"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[("1", day(3), 0), ("1", day(1), 1), (None, day(0), 2)], [("2", day(90), 3), ("1", day(1), 4)], [("1", day(0), 5), (None, None, 6), ("3", None, 7)]]
    out = tmp_path / "out"

    def run(batch, keep):
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = (
            feeds.stream_dedupe_once(stream, ["number"], keep)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "ck"))
            .trigger(availableNow=True)
            .start(str(out))
        )
        query.awaitTermination()
        return sorted(r["v"] for r in spark.read.schema(schema).parquet(str(out)).collect())

    assert run(batches[0], 3600) == [1, 2]
    assert run(batches[1], 3600) == [1, 2, 3]
    assert run(batches[2], 3600) == [1, 2, 3, 7]
    assert run([("3", None, 8)], 0.001) == [1, 2, 3, 7]
    # The state of "3" ends; of what timed out in a batch only later batches know.
    assert run([("9", day(5), 9)], 3600) == [1, 2, 3, 7, 9]
    assert run([("3", day(5), 10), ("2", day(5), 11)], 3600) == [1, 2, 3, 7, 9, 10]
    with pytest.raises(ValueError):
        feeds.stream_dedupe_once(spark.createDataFrame([], schema), ["number"], 0)
