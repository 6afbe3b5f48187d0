"""The conversation trie against a plain walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from cases import words
from pyspark.sql import functions as F

from siftwood.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHING = ["n", "id", "pos", "key", "seq", "grp", "at", "first", "base", "name", "depth", "tokens", "ends", "block"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


def brute(rows) -> list[tuple]:
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(ts)] for c, ts in turns.items()}
    members: dict[tuple, list] = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    children: dict[tuple, list] = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    done: dict[tuple, tuple] = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(words(node[-1][1])) if node else 0)
        done[node] = (sum(done[c][0] for c in below) or 1, saved + sum(done[c][1] for c in below))
    least = lambda node: min(c for c, _ in members[node])
    ends = lambda node: hashlib.sha256(",".join(str(c) for c, e in sorted(members[node]) if e).encode()).hexdigest()
    return sorted(
        (least(n), len(n), least(n[:-1]) if n else -(10**9), len(members[n]), len(children.get(n, [])), *done[n], ends(n)) for n in members
    )


def found(df) -> list[tuple]:
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in trie.RESULT) for r in df.collect())


def conversations(seed: int) -> list[tuple]:
    """Shared beginnings, copies, one conversation of a third of all rows and its near copy, odd rows."""
    rng = random.Random(seed)
    phrases = ["hello", "hello there", "", None, "how are you", "fine  \n thanks", "日本 é", "a b c d e"]
    rows = []
    for c in list(range(0, 60)) + [1000, 1001, 1019, 2**53 + 1, 2**53 + 3, -3, -20, -21]:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(phrases)) for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8]))]
        if c % 3 == 0:
            turns = [("user", "hello"), ("assistant", "fine")] + turns[:2]
        rows += [(c, i if i % 4 else None if i else 0, role, text) for i, (role, text) in enumerate(turns)]
    long = [("user" if i % 2 else "assistant", f"turn {rng.randrange(10)}") for i in range(150)]
    for c in (41, 42, 62):
        rows = [r for r in rows if r[0] != c]
        last = [("user", "another end")] if c == 42 else []
        rows += [(c, i, role, text) for i, (role, text) in enumerate(long + last)]
    rows += [(55, 1, "user", "tie"), (55, 1, "user", "tie"), (55, 1, "user", "tie two"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(56, None, None, None), (56, 0, "user", "x")]
    rows += [(c, i, "user", f"copy {i}") for c in range(200, 290) for i in range(4)]
    return rows


@pytest.mark.parametrize("segment,slice_keys", [(64, 20_000), (64, 5), (3, 7), (1, 2)])
def test_nodes_against_a_plain_walk(spark, segment, slice_keys):
    rows = conversations(segment)
    assert found(trie.trie(frame(spark, rows), segment, slice_keys)) == brute(rows)


def test_empty_tables_and_tables_without_any_conversation(spark):
    rows = conversations(1)
    assert trie.trie(frame(spark, rows).limit(0)).count() == 0
    assert trie.trie(frame(spark, [r for r in rows if r[0] is None])).count() == 0
    one = [(5, None, None, None)]
    assert found(trie.trie(frame(spark, one))) == brute(one)
    # Nothing is left of it: its base is absent and its only turn is among those left to the base.
    (turnless,) = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:1]
    assert [r[:6] for r in found(trie.trie(frame(spark, [(turnless, 0, "user", "hi")])))] == [(turnless, 0, -(10**9), 1, 0, 1)]


def test_the_tree_grows_through_all_layouts_and_keeps_every_key():
    rng = random.Random(3)
    keys = {bytes([b]) + bytes(15) for b in range(256)} | {bytes([7]) + rng.randbytes(rng.choice([15, 31])) for _ in range(600)}
    keys |= {bytes([9]) * 16 + bytes([b]) + bytes(15) for b in range(40)} | {b""}
    keys = rng.sample(sorted(keys), len(keys))
    root, sizes = trie.Node(b"", 0, 0), set()
    for i, key in enumerate(keys):
        trie.insert(root, key, i, i)
        sizes.add(4 if root.count <= 4 else 16 if root.count <= 16 else 48 if root.count <= 48 else 256)
    assert sizes == {4, 16, 48, 256}
    seen, stack = {}, [root]
    while stack:
        node = stack.pop()
        if node.value is not None:
            assert node.key[: node.end] == keys[node.value]
            seen[node.value] = True
        below = node.children()
        assert len(below) == node.count and (node is root or node.value is not None or len(below) > 1), "paths are compressed"
        stack += below
    assert len(seen) == len(keys)


def test_long_lists_of_ends_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    rows = [(c, i, "user", f"copy {i}") for c in range(0, 400, 20) for i in range(2)] + [(c, 0, "user", "copy 0") for c in range(1000, 2000, 20)]
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_the_registered_query(spark, sf):
    got = queries.QUERIES["op13_prefix_trie"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(got) == brute(rows)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
