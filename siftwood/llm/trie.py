"""Prefix trie of conversations by adaptive radix trees.

A turn's id is the first 16 bytes, big-endian, of the SHA-256 of its role's
length, its role and its text, so a conversation is a key of 16 bytes a turn and
nodes of the trie are the turn-aligned prefixes of keys. Tasks put sorted ranges
of keys into adaptive radix trees: inner nodes grow through layouts of 4, 16, 48
and 256 children, chains of one child are compressed into a path, and only byte
depths that end a turn emit a node.

No task holds more than a slice of keys, and no row more than SEGMENT turns:

- Keys are cut into segments of SEGMENT turns. A segment's group is named by a
  hash of all segments before it, made level by level from at most SEGMENT names
  a row, so a conversation of any length is spread. Equal segments of a group
  are counted before anything is sorted, so copies cost one key.
- A slice is a range of the sorted keys. Prefixes of its first and last key may
  go on in the next slices: these nodes come out in parts and are added up by
  Spark; all others are complete. A group's totals, which the segment above
  needs for its subtrees, are passed up by pointer doubling.
- The ids that end at a node are sorted by range, joined in chunks, and the
  chunks hashed as a stream.

Conversations are ordered by turn, null first, equal turns by their ids. Rows
without a conv_id belong to no conversation and are left out; a repeated row is
a turn of its own. Null roles and texts are empty. ``%`` keeps the sign of a
negative conv_id. Without any conversation there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.frames import SMALL_ROWS
from siftwood.llm.mixing import n_words
from siftwood.operators.numbering import number_rows

ID = 16
SEGMENT = 64
FAMILY = 20
# Keys in one tree, and ids in one chunk; more make more of them.
SLICE_KEYS = 20_000
CHUNK_IDS = 4_096

NOTHING = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, TOTAL = 0, 1, 2


# --- the radix tree --------------------------------------------------------------


class Node:
    """The end of a path of bytes, and the nodes that go on from it by first byte.

    ``key`` is a whole key that passes here and ``end`` the bytes of it that lead
    here, so a path needs no copy. Children are kept beside their ordered first
    bytes (up to 4, searched in turn; up to 16, by bisection), behind a table of
    256 places (up to 48), or in 256 slots."""

    __slots__ = ("key", "end", "row", "value", "first", "slots", "count", "state")

    def __init__(self, key: bytes, end: int, row: int, value: int | None = None):
        self.key, self.end, self.row, self.value = key, end, row, value
        self.first: bytearray | None = bytearray()
        self.slots: list[Node | None] = []
        self.count = 0

    def child(self, byte: int) -> Node | None:
        if self.count <= 4:
            at = self.first.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.count <= 16:
            at = bisect_left(self.first, byte)
            return self.slots[at] if at < self.count and self.first[at] == byte else None
        if self.count <= 48:
            at = self.first[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or replace the one of that byte."""
        if self.child(byte) is not None:
            at = bisect_left(self.first, byte) if self.count <= 16 else self.first[byte] - 1 if self.count <= 48 else byte
            self.slots[at] = node
            return
        if self.count == 16:
            table = bytearray(256)
            for place, b in enumerate(self.first):
                table[b] = place + 1
            self.first = table
        elif self.count == 48:
            slots: list[Node | None] = [None] * 256
            for b in range(256):
                if self.first[b]:
                    slots[b] = self.slots[self.first[b] - 1]
            self.first, self.slots = None, slots
        if self.count < 16:
            at = bisect_left(self.first, byte)
            self.first.insert(at, byte)
            self.slots.insert(at, node)
        elif self.count < 48:
            self.slots.append(node)
            self.first[byte] = len(self.slots)
        else:
            self.slots[byte] = node
        self.count += 1

    def children(self) -> list[Node]:
        return [c for c in self.slots if c is not None]


def _agree(a: bytes, b: bytes, start: int, end: int) -> int:
    """The first place from ``start`` where the keys differ, at most ``end``."""
    if a[start:end] == b[start:end]:
        return end
    while start < end and a[start] == b[start]:
        start += 1
    return start


def insert(root: Node, key: bytes, row: int, value: int) -> None:
    """Put a key, the ``row``-th of its slice, into the tree."""
    node = root
    while len(key) > node.end:
        byte = key[node.end]
        child = node.child(byte)
        if child is None:
            node.put(byte, Node(key, len(key), row, value))
            return
        split = _agree(key, child.key, node.end, min(len(key), child.end))
        if split < child.end:
            middle = Node(child.key, split, child.row)
            middle.put(child.key[split], child)
            node.put(byte, middle)
            child = middle
        node = child
    node.value = value


# --- nodes of one slice ----------------------------------------------------------

NODE = (
    "kind int, name string, virtual boolean, depth bigint, conv_id bigint, parent_conv_id bigint, parent string, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, tokens bigint, leads boolean, path array<string>"
)


def _name(group: str, prefix: bytes) -> str:
    return hashlib.sha256(group.encode() + b":" + prefix).hexdigest()[: 2 * ID] if prefix else group


def slice_nodes(group: str, depth: int, rows: list[tuple], after: bool, before: bool) -> list[list]:
    """NODE rows of a slice of a group that starts at ``depth`` turns.

    ``rows`` are (key, tokens of each turn, conversations, least conv_id, ends,
    group led to, and that group's children, leaves and saved tokens). With
    ``after`` or ``before`` other slices may hold smaller or larger keys of the
    group: prefixes of the first or last key are OPEN and come with what hangs
    complete below them, their path of names, and their own tokens apart."""
    root = Node(b"", 0, 0)
    for i, row in enumerate(rows):
        insert(root, bytes(row[0]), i, i)
    edges = [bytes(rows[0][0])] * after + [bytes(rows[-1][0])] * before
    out: list[list] = []
    order: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        node.state = [0, None, 0, 0, []]
        stack += [(child, node) for child in node.children()]
    for node, parent in reversed(order):
        members, least, leaves, saved, orphans = node.state
        own = rows[node.value] if node.value is not None else None
        if own is not None:
            members += own[2]
            least = own[3] if least is None else min(least, own[3])
        tokens = rows[node.row][1]
        for at in range(node.end // ID * ID, parent.end if parent else -1, -ID):
            here = own if at == node.end else None
            leads = here is not None and here[5] is not None
            kids = len(orphans)
            if leads:
                kids, leaves, saved = here[6], here[7], here[8]
            is_open = any(edge[:at] == node.key[:at] for edge in edges)
            words = tokens[at // ID - 1] if at else 0
            name = _name(group, node.key[:at])
            if not is_open:
                leaves = leaves if kids or leads else 1
                saved += (members - 1) * words
            for orphan in orphans:
                if is_open:
                    out[orphan][6] = name
                else:
                    out[orphan][5] = least
            path = [_name(group, node.key[:up]) for up in range(0, at, ID)] + [name] if is_open else None
            ends = here[4] if here is not None else None
            virtual = at == 0 and depth > 0
            row = [OPEN if is_open else CLOSED, name, virtual, depth + at // ID, least, None, None, members, kids, leaves, saved, ends, words, leads, path]
            orphans = []
            if virtual and not is_open:
                row[0] = TOTAL
            elif not is_open:
                orphans = [len(out)]
            out.append(row)
            if is_open:
                row[6] = path[-2] if at else None
                leaves = saved = 0
        if parent:
            up = parent.state
            up[0] += members
            up[1] = least if up[1] is None else min(up[1], least)
            up[2] += leaves
            up[3] += saved
            up[4] += orphans
    return out


def _trees(slice_keys: int) -> Callable:
    """mapInPandas function over rows sorted by group and key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task's first slice may go on from the last one of another task.
        group, depth, rows, first = None, 0, [], True

        def finished(before: bool) -> pd.DataFrame:
            # As objects, since floats would round ids beside a null.
            return pd.DataFrame(slice_nodes(group, depth, rows, first, before), columns=_NODE_COLUMNS, dtype=object)

        for batch in batches:
            for name, at, *row in batch[_ROW_COLUMNS].itertuples(index=False, name=None):
                row[4:] = [None if x is None or x != x else x for x in row[4:]]
                row[6:] = [None if x is None else int(x) for x in row[6:]]
                if rows and (name != group or len(rows) >= slice_keys):
                    yield finished(name == group)
                    first, rows = name == group, []
                group, depth = name, at
                rows.append(tuple(row))
        if rows:
            yield finished(True)

    return run


_NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
_ROW_COLUMNS = ["grp", "depth", "key", "tokens", "n", "least", "ends", "leads_to", "b_children", "b_leaves", "b_saved"]


# --- conversations as keys -------------------------------------------------------


def _joined(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts its right side only if it has few rows."""
    return df.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, how)


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, pos, id, tokens), and every
    conversation with its number of rebuilt turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * ID).alias("id"),
        n_words(F.col("text")).alias("tokens"),
    )
    numbered = number_rows(materialise(turns, "turns"), ["conv_id", "turn", "id"], "n")
    found = numbered.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    found = materialise(found.select("*", base.alias("base"), taken.cast("bigint").alias("taken")), "conversations")
    bases = found.where("base = conv_id").select("base", F.col("own").alias("of_base"))
    borrowed = F.least("taken", F.coalesce("of_base", F.lit(0)))
    told = _joined(found, bases, "base", "left").select("*", borrowed.alias("borrowed"))
    told = materialise(told.withColumn("turns", F.col("borrowed") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))), "told")

    placed = _joined(numbered, told, "conv_id").withColumn("pos", F.col("n") - F.col("first"))
    kept = placed.where("pos >= taken").select("conv_id", (F.col("pos") - F.col("taken") + F.col("borrowed")).alias("pos"), "id", "tokens")
    heads = placed.where("conv_id = base AND pos < 3").select("base", "pos", "id", "tokens")
    lent = _joined(told.where("borrowed > 0").select("conv_id", "base", "borrowed"), heads, "base").where("pos < borrowed")
    return kept.unionAll(lent.select("conv_id", "pos", "id", "tokens")), told.select("conv_id", "turns")


def _names(rows: DataFrame, fan: int) -> DataFrame:
    """(conv_id, seq, grp): a name for all that stands before each of a conversation's
    parts (conv_id, seq, name); equal where that is equal."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda s: s["name"])
    blocks = rows.groupBy("conv_id", F.floor(F.col("seq") / fan).alias("block")).agg(whole.alias("names"))
    blocks = materialise(blocks, "blocks")
    if blocks.agg(F.max("block")).first()[0]:
        upper = blocks.select("conv_id", F.col("block").alias("seq"), F.sha2(F.array_join("names", ""), 256).alias("name"))
        above = _names(upper, fan).withColumnsRenamed({"seq": "block", "grp": "above"})
        blocks = blocks.join(above, ["conv_id", "block"])
    else:
        blocks = blocks.withColumn("above", F.lit(""))
    parts = blocks.select("conv_id", "block", "names", "above", F.explode(F.sequence(F.lit(0), F.size("names") - 1)).alias("i"))
    seq = F.col("block") * fan + F.col("i")
    told = F.concat_ws(":", seq, "above", F.array_join(F.slice("names", F.lit(1), F.col("i")), ""))
    return parts.select("conv_id", seq.alias("seq"), F.when(seq == 0, "").otherwise(F.substring(F.sha2(told, 256), 1, 2 * ID)).alias("grp"))


def segments(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seq, grp, key, tokens, leads_to) of all rebuilt conversations. The
    last segment of a conversation holds fewer than ``segment`` turns, maybe none."""
    turns, told = _turns(conversations)
    row = F.array_sort(F.collect_list(F.struct("pos", "id", "tokens")))
    packed = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seq")).agg(row.alias("row"))
    key = F.unhex(F.array_join(F.transform("row", lambda t: t["id"]), ""))
    packed = packed.select("conv_id", "seq", key.alias("key"), F.transform("row", lambda t: t["tokens"]).alias("tokens"))
    none = told.where(F.col("turns") % segment == 0).select(
        "conv_id",
        F.floor(F.col("turns") / segment).alias("seq"),
        F.unhex(F.lit("")).alias("key"),
        F.array().cast("array<bigint>").alias("tokens"),
    )
    cut = materialise(packed.unionAll(none), "segments")
    if not cut.agg(F.max("seq")).first()[0]:
        return cut.withColumns({"grp": F.lit(""), "leads_to": F.lit(None).cast("string")})
    long = told.where(F.col("turns") >= segment).select("conv_id")
    parts = _joined(cut.select("conv_id", "seq", F.hex("key").alias("name")), long, "conv_id", "left_semi")
    names = materialise(_names(parts.withColumn("name", F.sha2("name", 256)), max(segment, 2)), "names")
    onward = names.where("seq > 0").select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("grp").alias("leads_to"))
    named = cut.join(names, ["conv_id", "seq"], "left").join(onward, ["conv_id", "seq"], "left")
    return materialise(named.withColumn("grp", F.coalesce("grp", F.lit(""))), "named")


def _key_name() -> Column:
    return F.sha2(F.concat(F.col("grp").cast("binary"), F.lit(":").cast("binary"), F.col("key")), 256)


def _hashed_ends(cut: DataFrame) -> DataFrame:
    """(at, ends): the hash of the ascending, comma-joined ids of the conversations
    that end with each group and key. Ids are sorted by range and joined in chunks,
    so a key of very many conversations is no row and no task of its own; its
    chunks then pass through one hash as a stream."""
    last = cut.where("leads_to IS NULL").select(_key_name().alias("at"), "conv_id")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids = None, []
        joined = lambda: pd.DataFrame([(at, ids[0], ",".join(map(str, ids)))], columns=["at", "first", "chunk"])
        for batch in batches:
            done = []
            for name, conv in zip(batch["at"], batch["conv_id"], strict=True):
                if ids and (name != at or len(ids) == CHUNK_IDS):
                    done.append(joined())
                    ids = []
                at = name
                ids.append(conv)
            if done:
                yield pd.concat(done)
        if ids:
            yield joined()

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for name, chunk in zip(batch["at"], batch["chunk"], strict=True):
                if name == at:
                    state.update(b"," + chunk.encode())
                else:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = name, hashlib.sha256(chunk.encode())
            if done:
                yield pd.DataFrame(done, columns=["at", "ends"])
        if state:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["at", "ends"])

    ordered = last.repartitionByRange("at", "conv_id").sortWithinPartitions("at", "conv_id")
    joined = ordered.mapInPandas(chunks, "at string, first bigint, chunk string")
    return joined.repartition("at").sortWithinPartitions("at", "first").mapInPandas(hashes, "at string, ends string")


def _rows(cut: DataFrame) -> DataFrame:
    """Equal segments of a group counted, with the hash of the ids that end there."""
    counted = cut.groupBy(_key_name().alias("at")).agg(
        F.first("grp").alias("grp"),
        F.first("seq").alias("seq"),
        F.first("key").alias("key"),
        F.first("tokens").alias("tokens"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        F.max("leads_to").alias("leads_to"),
    )
    return materialise(counted.join(_hashed_ends(cut), "at", "left").drop("at"), "keys")


def _nodes(rows: DataFrame, below: DataFrame | None, segment: int, slice_keys: int) -> tuple[DataFrame, DataFrame]:
    """All nodes but the open ones, and the open ones added up. ``below`` has
    the totals (grp, n_children, n_leaves, saved_tokens, ends) of the groups led to."""
    if below is None:
        rows = rows.withColumns({c: F.when(F.col("leads_to").isNotNull(), F.lit(0).cast("bigint")) for c in ["b_children", "b_leaves", "b_saved"]})
    else:
        # What ends where a group starts is kept with that group's empty key.
        renamed = {"grp": "leads_to", "n_children": "b_children", "n_leaves": "b_leaves", "saved_tokens": "b_saved"}
        straight = rows.where("leads_to IS NULL").withColumns({c: F.lit(None).cast("bigint") for c in ["b_children", "b_leaves", "b_saved"]})
        rows = straight.unionByName(_joined(rows.where("leads_to IS NOT NULL").drop("ends"), below.withColumnsRenamed(renamed), "leads_to"))
    rows = rows.withColumn("depth", F.col("seq") * segment).select(_ROW_COLUMNS)
    nodes = materialise(rows.repartitionByRange("grp", "key").sortWithinPartitions("grp", "key").mapInPandas(_trees(slice_keys), NODE), "nodes")

    merged = nodes.where(F.col("kind") == OPEN).groupBy("name").agg(
        *[F.first(c).alias(c) for c in ["virtual", "depth", "parent", "tokens", "path"]],
        *[F.sum(c).alias(c) for c in ["n_convs", "n_children", "n_leaves", "saved_tokens"]],
        F.min("conv_id").alias("conv_id"),
        F.max("ends").alias("ends"),
        F.max("leads").alias("leads"),
    )
    merged = materialise(merged, "open")
    inner = merged.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("more"))
    merged = merged.join(inner, "name", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf = F.when((F.col("n_children") == 0) & ~F.col("leads"), 1).otherwise(0)
    sums = merged.select(
        F.explode("path").alias("name"),
        (F.col("n_leaves") + leaf).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("tokens")).alias("saved"),
    )
    sums = sums.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    merged = merged.drop("n_leaves", "saved_tokens", "more").join(sums, "name")
    upper = merged.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.where(F.col("kind") != OPEN), materialise(merged.join(upper, "parent", "left"), "merged")


def _group_totals(rows: DataFrame, segment: int, slice_keys: int) -> DataFrame | None:
    """(grp, n_children, n_leaves, saved_tokens, ends) at the start of every group but
    the first, with all groups further down, by pointer doubling."""
    links = rows.where("leads_to IS NOT NULL").select(F.col("leads_to").alias("grp"), F.col("grp").alias("up")).distinct()
    links = materialise(links, "links")
    if links.isEmpty():
        return None
    complete, merged = _nodes(rows.where("grp <> ''"), None, segment, slice_keys)
    columns = ["n_children", "n_leaves", "saved_tokens", "ends"]
    totals = complete.where(F.col("kind") == TOTAL).select(F.col("name").alias("grp"), *columns)
    sums = materialise(totals.unionAll(merged.where("virtual").select(F.col("name").alias("grp"), *columns)), "totals")
    links = links.where("up <> ''")
    while not links.isEmpty():
        added = links.join(sums, "grp").groupBy(F.col("up").alias("grp")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        sums = materialise(
            sums.join(added, "grp", "left").select(
                "grp",
                "n_children",
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
                "ends",
            ),
            "totals",
        )
        jumps = links.select(F.col("grp").alias("up"), F.col("up").alias("next"))
        links = materialise(links.join(jumps, "up").select("grp", F.col("next").alias("up")), "links")
    return sums


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, segment: int = SEGMENT, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """One row per node: its least member and depth, its parent's least member,
    members, children, leaves below, tokens saved below by storing each node once,
    and the hash of the ids of the members that end there."""
    rows = _rows(segments(conversations, segment))
    complete, merged = _nodes(rows, _group_totals(rows, segment, slice_keys), segment, slice_keys)
    columns = [c for c in RESULT if c != "ends_sha256"]
    ends = F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    closed = complete.where(F.col("kind") == CLOSED)
    upper = merged.select(F.col("name").alias("parent"), F.col("conv_id").alias("_above"))
    hanging = _joined(closed.where("parent IS NOT NULL").drop("parent_conv_id"), upper, "parent").withColumnRenamed("_above", "parent_conv_id")
    parts = [closed.where("parent IS NULL"), hanging, merged.where(~F.col("virtual"))]
    return parts[0].select(*columns, ends).unionAll(parts[1].select(*columns, ends)).unionAll(parts[2].select(*columns, ends))
