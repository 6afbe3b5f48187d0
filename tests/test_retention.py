import os
import time

import pytest

from siftwood.cluster import materialise, scratch_root
from siftwood.sinks import bucket_store, index_store, retention


def publish(spark, root, alias, version, values):
    docs = spark.createDataFrame([(v,) for v in values], "doc_id string")
    layouts = {"docs": index_store.Layout(bucket_by="doc_id", buckets=2)}
    index_store.publish_index(spark, root, alias, {"docs": docs}, version, layouts)


def ids(tables):
    return sorted(r["doc_id"] for r in tables["docs"].collect())


def folders(root):
    return sorted(f for f in os.listdir(root) if not f.startswith(("_", ".")))


def test_an_open_reader_survives_a_cleanup_and_an_old_version_does_not(spark, tmp_path):
    root = str(tmp_path / "indexes")
    assert retention.retire_builds(spark, root) == []
    publish(spark, root, "a", 1, ["x"])
    publish(spark, root, "a", 2, ["y"])
    with retention.leased(spark, root, "a") as lease:
        assert lease.names == ("a_2",)
        publish(spark, root, "a", 3, ["z"])
        publish(spark, root, "b", 1, ["other"])
        reader = index_store.open_build(spark, f"{root}/{lease.names[0]}")
        assert retention.retire_builds(spark, root) == []  # replaced just now
        assert retention.retire_builds(spark, root, keep=3, grace=0) == []
        time.sleep(1.1)
        assert retention.retire_builds(spark, root, grace=0) == ["a_1"]
        assert folders(root) == ["a_2", "a_3", "b_1"] and ids(reader) == ["y"]
    time.sleep(0.01)
    assert retention.retire_builds(spark, root, grace=0) == ["a_2"]
    assert retention.retire_builds(spark, root, grace=0) == []
    assert ids(index_store.open_index(spark, root, "a")) == ["z"]
    assert ids(index_store.open_index(spark, root, "b")) == ["other"]
    assert not [t for t in spark.catalog.listTables() if "_a_2_" in t.name]


def test_leases_end_and_are_renewed(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, "a", 1, ["x"])
    lease = retention.take_lease(spark, root, "a", 0.001)
    time.sleep(0.01)
    assert retention.held_builds(spark, root) == set()
    lease.renew(60)
    assert retention.held_builds(spark, root) == {"a_1"}
    lease.give_back()
    time.sleep(0.01)
    assert retention.held_builds(spark, root) == set()
    with pytest.raises(ValueError):
        retention.take_lease(spark, root, "unknown", 1)


def test_segments_of_the_present_build_stay_and_abandoned_builds_go(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, "a", 1, ["x"])
    publish(spark, root, "a", 2, ["y"])
    index_store.switch_alias(spark, root, "a", 3, ["a_1", "a_2"])
    index_store.write_tables(f"{root}/a_9", {"docs": spark.range(3)}, {})  # never published
    os.makedirs(f"{root}/notes")
    time.sleep(1.1)
    assert retention.retire_builds(spark, root, grace=0) == []
    assert retention.retire_builds(spark, root, grace=0, abandoned=3600) == []
    assert retention.retire_builds(spark, root, grace=0, abandoned=0) == ["a_9"]
    assert folders(root) == ["a_1", "a_2", "notes"]
    with pytest.raises(ValueError):
        retention.retire_builds(spark, root, keep=0)


def test_bucket_folders_of_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(str(i), 0, 0) for i in range(40)], "number string, v int, page int")
    bucket_store.create_store(rows, root, "number", 4)
    old = bucket_store.open_store(spark, root)
    for v in (1, 2):
        bucket_store.merge_store(spark, root, spark.createDataFrame([("7", v, 0)], rows.schema), ["page"])
    assert retention.retire_buckets(spark, root) == []
    now = bucket_store.open_store(spark, root)
    want = sorted((r["number"], r["v"]) for r in now.read(spark).collect())
    gone = retention.retire_buckets(spark, root, grace=0)
    assert len(gone) == 2 and not set(gone) & set(now.folders.values()) and set(gone) & set(old.folders.values())
    assert sorted((r["number"], r["v"]) for r in now.read(spark).collect()) == want and ("7", 2) in want
    assert retention.retire_buckets(spark, root, grace=0) == []


def test_only_old_scratch_folders_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("siftwood.cluster.scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(retention, "scratch_root", lambda _: str(tmp_path))
    assert scratch_root(spark)
    materialise(spark.range(2), "some-hits")
    os.makedirs(tmp_path / "mine")
    assert retention.clear_scratch(spark, 3600) == []
    time.sleep(0.01)
    (gone,) = retention.clear_scratch(spark, 0)
    assert gone.startswith("some-hits-") and os.listdir(tmp_path) == ["mine"]
