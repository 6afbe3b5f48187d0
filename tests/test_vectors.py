import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwood.functions import encoders
from siftwood.functions.vectors import unit_vector
from siftwood.operators import cells as cl
from siftwood.operators import neighbours as nb


def vectors(spark, n, dims=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims))
    if copies:  # one point holds a third of the table
        points[:copies] = points[0]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = points.astype(np.float32)
    rows = [(f"d{i:04d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_id string, vec array<float>"), points


def as_queries(df):
    return df.select(F.substring("doc_id", 2, 9).cast("bigint").alias("qid"), "vec")


def brute(points, queries, k, allowed=None):
    hits = set()
    for q, qv in enumerate(queries):
        scored = []
        for d, dv in enumerate(points):
            if allowed is None or (q, d) in allowed:
                scored.append((-round((1 + float(np.dot(qv.astype(float), dv.astype(float)))) / 2, 6), f"d{d:04d}"))
        for rank, (s, doc) in enumerate(sorted(scored)[:k], 1):
            hits.add((q, rank, doc, round(-s, 6)))
    return hits


def as_set(df):
    return {(r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect()}


def test_unit_vector(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],)]
    df = spark.createDataFrame(rows, "vec array<float>")
    got = [r["u"] for r in df.select(unit_vector(F.col("vec")).alias("u")).collect()]
    assert got == [[0.6, 0.8], None, None, [1.0]]


@pytest.mark.parametrize("copies", [0, 40])
def test_knn_matches_brute_force(spark, copies):
    df, points = vectors(spark, 120, copies=copies)
    assert as_set(nb.knn(df.repartition(5), as_queries(df), 7)) == brute(points, points, 7)


def test_knn_beyond_the_broadcast_bound_is_the_same(spark):
    df, points = vectors(spark, 90, copies=30)
    queries = as_queries(df)
    assert as_set(nb.knn(df, queries, 5, max_query_bytes=0)) == brute(points, points, 5)


def test_both_forms_give_the_same_scores_for_doubles(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"d{i:04d}", p.tolist()) for i, p in enumerate(points)], "doc_id string, vec array<double>")
    direct, packed = (nb.knn(df, as_queries(df), 9, max_query_bytes=n).collect() for n in (1 << 20, 0))
    assert sorted(map(tuple, direct)) == sorted(map(tuple, packed))


def test_unequal_widths_raise(spark):
    rows = [("d0001", [1.0, 0.0]), ("d0002", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id string, vec array<float>").coalesce(1)
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid bigint, vec array<float>")
    with pytest.raises(Exception, match="one width"):
        nb.knn(df, one, 2).collect()


def test_knn_ignores_null_vectors_and_empty_sides(spark):
    df, points = vectors(spark, 10)
    gaps = df.withColumn("vec", F.when(F.col("doc_id") != "d0003", F.col("vec")))
    hits = nb.knn(gaps, as_queries(gaps), 10)
    assert hits.where("doc_id = 'd0003' or qid = 3").count() == 0 and hits.count() == 81
    assert nb.knn(df, as_queries(df).where("qid < 0"), 3).count() == 0
    assert nb.knn(df.where("doc_id = ''"), as_queries(df), 3).count() == 0


def test_knn_filtered(spark):
    df, points = vectors(spark, 40)
    allowed = {(q, d) for q in range(40) for d in range(40) if (q * d) % 3 == 1}
    pairs = spark.createDataFrame([(q, f"d{d:04d}") for q, d in allowed], "qid bigint, doc_id string")
    assert as_set(nb.knn(df, as_queries(df), 4, filter=pairs)) == brute(points, points, 4, allowed)


@pytest.fixture(scope="module")
def celled(spark):
    df, points = vectors(spark, 400, dims=16)
    centres = cl.train_cells(df, 8)
    return df, points, centres, cl.pack_cells(df, centres).cache()


def test_knn_approx_recall_and_full_probe(celled):
    df, points, centres, cells = celled
    truth = {(q, d) for q, _, d, _ in brute(points, points, 10)}
    found = {(q, d) for q, _, d, _ in as_set(cl.knn_approx(cells, centres, df, as_queries(df), 10, nprobe=6))}
    assert len(truth & found) / len(truth) >= 0.9
    # All cells probed: only the 8-bit cut to 2k can lose a neighbour.
    full = as_set(cl.knn_approx(cells, centres, df, as_queries(df), 10, nprobe=8))
    assert len(truth & {(q, d) for q, _, d, _ in full}) / len(truth) >= 0.99
    # Joined by shuffle instead of a broadcast.
    assert as_set(cl.knn_approx(cells, centres, df, as_queries(df), 10, nprobe=8, max_query_bytes=0)) == full


def test_each_of_many_queries_hands_on_one_list(celled, monkeypatch):
    df, points, centres, cells = celled
    handed, ranked = [], cl.top_k
    monkeypatch.setattr(cl, "top_k", lambda found, k, cut: handed.append((k, found.count())) or ranked(found, k, cut=cut))
    monkeypatch.setattr(cl, "_BLOCK", 64)
    whole = as_set(cl.knn_approx(cells, centres, df, as_queries(df), 3, nprobe=8))
    assert handed[0] == (6, 6 * len(as_queries(df).collect()))
    assert as_set(cl.knn_approx(cells, centres, df, as_queries(df), 3, nprobe=8, max_query_bytes=0)) == whole


def test_knn_approx_of_any_depth_is_one_plan(spark, celled, monkeypatch):
    df, points, centres, cells = celled
    every = brute(points, points, 400)
    # More rows than a task may keep, one large query, and a depth beyond the table.
    monkeypatch.setattr(nb, "KEPT_ROWS", 50)
    assert as_set(cl.knn_approx(cells, centres, df, as_queries(df), 400, nprobe=8)) == every
    one = as_queries(df).where("qid = 7")
    assert as_set(cl.knn_approx(cells, centres, df, one, 5_000, nprobe=8)) == {r for r in every if r[0] == 7}
    assert cl.knn_approx(cells, centres, df, one.where("qid < 0"), 5).count() == 0
    assert cl.knn_approx(cells.where("cell < 0"), centres, df, one, 5).count() == 0


def test_cells_hold_every_vector_and_split_large_ones(spark, celled, monkeypatch):
    df, points, centres, cells = celled
    held = [(i, r["cell"]) for r in cells.collect() for i in r["ids"]]
    assert sorted(i for i, _ in held) == sorted(r["doc_id"] for r in df.collect())
    near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert all(near[int(i[1:])] == cell for i, cell in held)
    monkeypatch.setattr(cl, "_BLOCK", 10)
    small = cl.pack_cells(df, centres).collect()
    assert max(len(r["ids"]) for r in small) == 10 and sum(len(r["ids"]) for r in small) == 400
    assert cl.read_centres(cl.centres_table(spark, centres)).tolist() == centres.tolist()


def test_packed_exact_search_keeps_one_result_per_query_block(spark, monkeypatch):
    df, points = vectors(spark, 300, copies=120)
    want = brute(points, points, 9)
    monkeypatch.setattr(nb, "_BLOCK", 16)
    assert as_set(nb.knn(df, as_queries(df), 9, max_query_bytes=0)) == want
    monkeypatch.setattr(nb, "KEPT_ROWS", 40)
    assert as_set(nb.knn(df, as_queries(df), 9, max_query_bytes=0)) == want


def test_pooling(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 1, [5.0, 6.0])]
    tokens = spark.createDataFrame(rows, "doc_id int, pos int, mask int, vec array<float>")
    mean = {r["doc_id"]: r["vec"] for r in nb.mean_pool(tokens).collect()}
    first = {r["doc_id"]: r["vec"] for r in nb.cls_pool(tokens).collect()}
    assert mean == {1: [2.0, 3.0], 2: [5.0, 6.0]}
    assert first == {1: [1.0, 2.0], 2: [5.0, 6.0]}


def test_hash_encoder_is_unit_and_ignores_row_order(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "b a b"), (3, "..."), (4, "c")], "id int, t string")
    vecs = {r["id"]: r["vec"] for r in encoders.encode(df, "id", F.col("t")).collect()}
    assert vecs[1] == vecs[2] and 3 not in vecs
    assert all(math.isclose(sum(x * x for x in v), 1, abs_tol=1e-6) and len(v) == 64 for v in vecs.values())


def test_model_encoder_runs_a_batch_model(spark):
    def make_predict():
        def predict(texts):
            return np.stack([np.array([len(t), 1.0], dtype=np.float32) for t in texts])

        return predict

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, t string")
    vecs = encoders.encode(df, "id", F.col("t"), encoders.model_encoder(make_predict)).collect()
    assert {r["id"]: r["vec"] for r in vecs} == {1: [2.0, 1.0], 2: [3.0, 1.0]}


def test_many_equal_scores_in_small_blocks(spark, monkeypatch):
    # Products in blocks of a few scores, several batches per task, most rows equal.
    monkeypatch.setattr(nb, "_PRODUCT", 64)
    df, points = vectors(spark, 200, copies=150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = as_set(nb.knn(df.repartition(3), as_queries(df), 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(points, points, 6)


def token_model(calls=None):
    """Words as tokens: (length, 1) each, padded with large numbers that a mask hides."""

    def make():
        def predict(texts):
            split = [t.split() for t in texts]
            longest = max(map(len, split))
            vectors = np.full((len(split), longest, 2), 1e6, np.float32)
            mask = np.zeros((len(split), longest), np.int64)
            for i, ws in enumerate(split):
                mask[i, : len(ws)] = 1
                for j, w in enumerate(ws):
                    vectors[i, j] = len(w), 1
            return vectors, mask

        return predict

    return make


@pytest.mark.parametrize("budget", [1, 40, 1 << 20])
def test_token_models_are_pooled_in_packed_batches(spark, budget):
    texts = [(i, " ".join("x" * (1 + (i * k) % 7) for k in range(1, 1 + i % 90))) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    for pooling in encoders.POOLINGS:
        encoder = encoders.token_model_encoder(token_model(), pooling, budget)
        got = {r["id"]: r["vec"] for r in encoders.encode(df, "id", F.col("t"), encoder).collect()}
        assert len(got) == 201 and got[200] is None
        for i, text in texts[:200]:
            sizes = [len(w) for w in text.split()]
            if sizes:
                want = [sum(sizes) / len(sizes) if pooling == "mean" else sizes[0], 1.0]
                assert got[i] == pytest.approx(want, rel=1e-6)
            elif pooling == "mean":
                assert got[i] is None
    with pytest.raises(ValueError):
        encoders.token_model_encoder(token_model(), "max")
    assert encoders.encode(df.limit(0), "id", F.col("t"), encoder).count() == 0


def test_packed_batches_stay_in_their_budget():
    sizes = np.array([5, 1, 90, 7, 7, 0, 30, 200, 1, 2])
    parts = [p.tolist() for p in encoders.packed_batches(sizes, 60)]
    assert sorted(sum(parts, [])) == list(range(10))
    assert all(len(p) == 1 or len(p) * sizes[p].max() <= 60 for p in parts) and len(parts) == 4
    assert list(encoders.packed_batches(np.array([], np.int64), 60)) == []


def test_mean_pool_of_unmasked_and_missing_rows(spark):
    rows = [(1, 0, [9.0]), (2, 1, None), (3, 1, [4.0]), (3, 1, None)]
    tokens = spark.createDataFrame(rows, "doc_id int, mask int, vec array<float>")
    assert [tuple(r) for r in nb.mean_pool(tokens).collect()] == [(3, [4.0])]
    assert nb.mean_pool(tokens.limit(0)).count() == 0


def _traced_peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_ranks_the_hits_of_few_queries_at_a_time():
    rng = np.random.default_rng(3)
    queries, docs = rng.normal(size=(20_000, 4)), rng.normal(size=(2000, 4))
    batch = pa.record_batch([pa.array([f"d{i:05d}" for i in range(2000)]), pa.array(docs.tolist(), pa.list_(pa.float64()))], names=["doc_id", "vec"])
    found = []
    run = lambda: found.extend(b.num_rows for b in nb._scan_with(np.arange(20_000), queries, 10)(iter([batch])))
    assert _traced_peak(run) < 100
    assert sum(found) == 200_000 and max(found) < 20_000


def test_a_task_makes_objects_of_one_row_of_a_batch_at_a_time():
    ids = [[f"doc{r}-{i}" for i in range(1024)] for r in range(400)]
    columns = {
        "cell": pa.array([0] * 400, pa.int32()), "ids": pa.array(ids), "codes": pa.array([bytes(1024)] * 400, pa.binary()),
        "qids": pa.array([[r] for r in range(400)], pa.list_(pa.int64())), "asked": pa.array([bytes(1)] * 400, pa.binary()),
    }
    batch, found = pa.record_batch(list(columns.values()), names=list(columns)), []
    del ids, columns
    run = lambda: found.extend(b.num_rows for b in cl._scanned(2, 1000)(iter([batch])))
    assert _traced_peak(run) < 12
    assert sum(found) == 800
