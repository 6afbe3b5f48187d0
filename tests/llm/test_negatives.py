"""Hard negatives against an exhaustive search in Python integers."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwood.llm import negatives, queries

CLASHING = ["vec", "cell", "block", "row", "n", "floor", "goals", "rank", "score", "part"]


def frame(spark, rows, kind="float"):
    out = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return out.withColumns({c: F.lit("clash") for c in CLASHING})


def remainder(a: int, b: int) -> int:
    return int(math.fmod(a, b))


def brute(rows, single=True) -> list[tuple]:
    by_id: dict[int, tuple] = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = [math.floor(256 * float(np.float32(x) if single else x)) for x in vec]
        row = (remainder(label + 1, 10) if i % 7 == 0 else label, whole)
        by_id[i] = min(by_id.get(i, row), row)
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: E731, B905
    out = []
    for a, (label, vec) in by_id.items():
        if a % 100:
            continue
        scored = sorted((-dot(vec, v), i, other) for i, (other, v) in by_id.items() if i != a)
        for minus, positive, _ in [r for r in scored if r[2] == label][:5]:
            p = -minus
            window = [(i, -s) for s, i, other in scored if other != label and 80 * p <= 100 * -s <= 100 * p]
            out += [(a, positive, r + 1, i, p, s) for r, (i, s) in enumerate(window[:5])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found(df) -> list[tuple]:
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["bigint"] * 6
    return sorted(tuple(r) for r in df.collect())


def clustered(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    for i in range(1, n, 3):  # a third of all rows are copies
        rows[i] = (i, rows[1][1], rows[i][2])
    return rows


@pytest.mark.parametrize("block_rows,block_anchors,first_rows", [(8192, 4096, 4000), (256, 3, 30)])
def test_results_equal_an_exhaustive_search(spark, monkeypatch, block_rows, block_anchors, first_rows):
    for name, value in [("BLOCK_ROWS", block_rows), ("BLOCK_ANCHORS", block_anchors), ("FIRST_ROWS", first_rows), ("AT_ONCE", 2)]:
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(1500, 1)
    assert found(negatives.mine(frame(spark, rows))) == brute(rows)


def test_odd_rows_ties_and_ends(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(-200, 260)]
    rows += [(300, [1.0, 1.0, 0.0, 0.0], 1), (301, [1.0, 1.0, 0.0, 0.0], 1), (302, [1.0, 0.9, 0.0, 0.0], 2), (303, [1.0, 0.9, 0.0, 0.0], 2)]
    rows += [(400, None, 1), (401, [1.0, nan, 0.0, 0.0], 1), (402, [inf] * 4, 1), (403, [1.0, None, 0.0, 0.0], 1), (404, [1.0] * 4, None)]
    rows += [(500, [0.0] * 4, 1), (600, [], 1), (601, [2.0], 2), (None, [9.0] * 4, 1), (700, [1.0] * 4, -1), (701, [1.0] * 4, 12)]
    rows += [(800, [1.0, 0.0, 0.0, 0.0], 2), (800, [0.5, 0.0, 0.0, 0.0], 1), (800, [0.5, 0.0, 0.0, 0.0], 1)]
    assert found(negatives.mine(frame(spark, rows))) == brute(rows)
    assert found(negatives.mine(frame(spark, rows).limit(0))) == []
    assert found(negatives.mine(frame(spark, [r for r in rows if r[0] in (400, 402)]))) == []
    assert found(negatives.mine(frame(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]))) == [(100, 101, 1, 102, 0, 0)]


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 2.0 ** rng.integers(0, 22)).tolist(), int(i % 3)) for i in range(0, 300, 4)]
    rows += [(1000, [1e30] * 6, 0), (1001, [1e30] * 6, 0), (1002, [1e25] * 6, 1), (1003, [-1e300] * 6, 1)]
    clipped = [(i, [max(min(x, 2**55), -(2**55)) for x in v], label) for i, v, label in rows]
    small = [r for r in rows if r[0] < 1000]
    assert found(negatives.mine(frame(spark, small, "double"))) == brute(small, single=False)
    got = found(negatives.mine(frame(spark, rows, "double")))
    assert [r[:4] for r in got if r[0] < 1000] == [r[:4] for r in brute(clipped, single=False) if r[0] < 1000]


def test_the_walk_is_in_order_of_bounds_and_stops_early():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 2, 10)) * 500
    points = np.concatenate([centres[rng.integers(0, 8, 4000), h] + rng.normal(size=(4000, 10)) * 5 for h in (0, 1)], 1).round()
    own = [np.square(points[:, None, 10 * h : 10 * h + 10] - centres[None, :, h]).sum(2).argmin(1) for h in (0, 1)]
    cell = own[0] * 8 + own[1]
    far = [np.sqrt(np.square(points[:, 10 * h : 10 * h + 10] - centres[own[h], h]).sum(1)) for h in (0, 1)]
    radii = [np.array([f[o == k].max(initial=0) for k in range(8)]) for f, o in zip(far, own, strict=True)]
    cells = negatives.Cells(centres[:, 0], centres[:, 1], *radii, np.bincount(cell, minlength=64))
    for anchor in points[:20]:
        order = list(negatives.walk(cells, anchor))
        bounds = [b for _, b in order]
        assert bounds == sorted(bounds, reverse=True) and {c for c, _ in order} == set(cell)
        score = points @ anchor
        assert all(score[cell == c].max() <= b for c, b in order)
        fifth = np.sort(score)[-5]
        assert sum(b >= fifth for b in bounds) < len(bounds) / 4, "tight groups are found in few cells"


def test_the_registered_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.QUERIES["op11_hard_negatives"](spark, sf)) == brute(rows)


def test_long_walks_of_many_anchors_are_handed_on_bit_by_bit(monkeypatch):
    monkeypatch.setattr(negatives, "ASKED_CELLS", 100)
    rng = np.random.default_rng(5)
    cells = negatives.Cells(*(rng.normal(size=(8, 3)) for _ in range(2)), np.ones(8), np.ones(8), np.full(64, negatives.FIRST_ROWS))
    n_blocks = np.where(np.arange(64) == 9, 3, 1)
    first_block = np.arange(64) // 4 + 2 * (np.arange(64) > 9)
    vecs = [rng.integers(-9, 9, 6) for _ in range(40)]
    anchors = pd.DataFrame({"anchor_id": range(40), "label": 0, "vec": vecs, "goals": [np.array([1])] * 40, "floor": [None] * 40})
    shared, placed = (SimpleNamespace(value=x) for x in (cells, (first_block, n_blocks)))
    frames = list(negatives._ask(shared, placed, 6, False)(iter([anchors])))
    assert max(sum(map(len, f["cells"])) for f in frames) < 200
    found = [(r.anchor_id, r.block, c) for f in frames for r in f.itertuples() for c in r.cells]
    walks = [(i, list(negatives.walk(cells, v.astype(float)))[1:]) for i, v in enumerate(vecs)]
    assert sorted(found) == sorted((i, first_block[c] + k, c) for i, walked in walks for c, _ in walked for k in range(n_blocks[c]))
