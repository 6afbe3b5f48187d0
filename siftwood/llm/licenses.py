"""License notices in texts: windows retrieve templates by MinHash bands, and
exact containment of shingles decides.

Words are runs of letters and digits, A-Z folded. A template of m shingles (five
words each) is sought in overlapping windows of 2h shingles, a step of h apart,
with h the power of two not below m; a copy lies whole in one of them. Its
similarity to the window is then at least LEAST * m / (2h + (1 - LEAST) * m),
above 0.18, and BANDS bands of one row collide with probability 1 - (1 - s) **
BANDS: above 0.99 there, above 0.9999 for a whole copy with m = h. A template of
one shingle needs one band. Window minima come from minima of half windows.

A band match is a candidate. In the union of a template's overlapping candidate
windows its shingles are then found exactly, and cut into pieces where the
template starts over or pauses for longer than itself: every piece with LEAST of
the template is a match, so notices in a row are told apart and a stray phrase
before one is not part of it. Between such pieces the least span of at most 2h
shingles with LEAST of the template, in any order, is a match; it goes on over
neighbouring shingles that are new to it. Templates are a given table or mapping
of at most MOST_TEMPLATES; more raise. Null and empty texts match nothing; every
row is scanned whole and for itself.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm.frames import spread, whole_text
from siftwood.llm.words import Texts, as_bytes, mix, not_alphanumeric, slices, windows

SHINGLE = 5
LEAST = 0.8
BANDS = 24
MOST_TEMPLATES = 10_000
MOST_CHARACTERS = 32 << 20  # of all templates of a table

# Short public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

_seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word (counted in its text) and owning text of each shingle."""
    hashes, owners, _ = t.words(fold=True, apart=not_alphanumeric)
    keys, first = windows(hashes, owners, SHINGLE)
    n_words = np.bincount(owners, minlength=t.n)
    return keys, first - (np.cumsum(n_words) - n_words)[owners[first]], owners[first]


def _half(m: int) -> int:
    return 1 << (m - 1).bit_length()


class Templates:
    """Band values of the templates, by window size."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = []
        self.places: list[dict[int, list[int]]] = []
        self.sizes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_half: dict[int, list[int]] = {}
        for i, name in enumerate(self.names):
            ordered = shingles(Texts([as_bytes(texts[name])]))[0]
            keys = np.unique(ordered)
            self.sets.append(keys)
            places: dict[int, list[int]] = {}
            for place, key in enumerate(ordered.tolist()):
                places.setdefault(key, []).append(place)
            self.places.append(places)
            if len(keys):
                by_half.setdefault(_half(len(keys)), []).append(i)
        for half, members in by_half.items():
            bands = []
            for seed in _seeds[: 1 if half == 1 else BANDS]:
                values = np.array([mix(self.sets[i] ^ seed).min() for i in members], np.uint64)
                order = np.argsort(values)
                bands.append((values[order], np.array(members)[order]))
            self.sizes[half] = bands

    def candidates(self, keys: np.ndarray, owners: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first, end) of windows, in shingles of one run of texts, that share a band."""
        out: set[tuple[int, int, int]] = set()
        if not len(keys):
            return out
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        lengths = np.diff(np.r_[starts, len(keys)])
        blocks = {}
        for half in self.sizes:
            n = -(-lengths // half)
            first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * half
            last = np.zeros(len(first), bool)
            last[np.cumsum(n) - 1] = True
            blocks[half] = first, last
        for k, seed in enumerate(_seeds):
            values = mix(keys ^ seed)
            for half, bands in self.sizes.items():
                if k >= len(bands):
                    continue
                known, members = bands[k]
                first, last = blocks[half]
                low = np.minimum.reduceat(values, first) if half > 1 else values
                if half > 1:
                    low = np.where(last, low, np.minimum(low, np.r_[low[1:], low[-1:]]))
                table = np.zeros(1 << 16, bool)
                table[known & np.uint64(0xFFFF)] = True
                maybe = np.flatnonzero(table[low & np.uint64(0xFFFF)])
                for w in maybe[np.isin(low[maybe], known)]:
                    a = first[w]
                    end = min(a + (2 * half if half > 1 else 1), starts[np.searchsorted(starts, a, "right") - 1] + lengths[np.searchsorted(starts, a, "right") - 1])
                    for j in range(np.searchsorted(known, low[w], "left"), np.searchsorted(known, low[w], "right")):
                        out.add((int(members[j]), int(a), int(end)))
        return out

    def _pieces(self, i: int, at: list[int], hits: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of hits in which template ``i`` goes forward without a long pause."""
        places, pause = self.places[i], max(len(self.sets[i]), SHINGLE)
        first, place = 0, -1
        for k, key in enumerate(hits):
            known = places[key]
            later = bisect_right(known, place)
            if k > first and (later == len(known) or at[k] - at[k - 1] > pause):
                yield first, k
                first, later = k, 0
            place = known[min(later, len(known) - 1)]
        if hits:
            yield first, len(hits)

    def _least_spans(self, i: int, at: list[int], hits: list[int], low: int, high: int) -> Iterator[tuple[int, int]]:
        """Ranges of hits with LEAST of template ``i`` in any order, from the left."""
        need, width = LEAST * len(self.sets[i]), 2 * _half(len(self.sets[i]))
        first, end, seen = low, low, Counter()
        while end < high:
            seen[hits[end]] += 1
            end += 1
            while at[end - 1] - at[first] >= width or seen[hits[first]] > 1:
                seen[hits[first]] -= 1
                if not seen[hits[first]]:
                    del seen[hits[first]]
                first += 1
            if len(seen) < need:
                continue
            while first > low and at[first] - at[first - 1] <= SHINGLE and hits[first - 1] not in seen:
                first -= 1
                seen[hits[first]] += 1
            while end < high and at[end] - at[end - 1] <= SHINGLE and hits[end] not in seen:
                seen[hits[end]] += 1
                end += 1
            yield first, end
            low = first = end
            seen.clear()

    def spans(self, i: int, at: list[int], hits: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of hits, in order, that are matches of template ``i``; ``at`` is
        where each hit lies, in shingles."""
        need, done = LEAST * len(self.sets[i]), 0
        for a, b in self._pieces(i, at, hits):
            if len(set(hits[a:b])) >= need:
                yield from self._least_spans(i, at, hits, done, a)
                yield a, b
                done = b
        yield from self._least_spans(i, at, hits, done, len(hits))

    def matches(self, texts: list[bytes]) -> list[tuple[int, str, int, int, float]]:
        """(text, license, start_word, end_word, containment) of some texts, in order."""
        keys, words, owners = shingles(Texts(texts))
        areas: list[list[int]] = []
        for i, a, b in sorted(self.candidates(keys, owners)):
            if areas and areas[-1][0] == i and a <= areas[-1][2] and owners[a] == owners[areas[-1][1]]:
                areas[-1][2] = max(areas[-1][2], b)
            else:
                areas.append([i, a, b])
        out = []
        for i, a, b in areas:
            places = np.flatnonzero(np.isin(keys[a:b], self.sets[i])) + a
            at, hits = places.tolist(), keys[places].tolist()
            for first, end in self.spans(i, at, hits):
                share = len(set(hits[first:end])) / len(self.sets[i])
                out.append((int(owners[a]), self.names[i], int(words[at[first]]), int(words[at[end - 1]]) + SHINGLE, share))
        return sorted(out)


def _scan(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(shared.value)
        for batch in batches:
            ids, texts = batch["doc_id"], [as_bytes(x) for x in batch["text"]]
            for a, b in slices(texts):
                rows = templates.matches(texts[a:b])
                if rows:
                    frame = pd.DataFrame(rows, columns=["at", "license", "start_word", "end_word", "containment"])
                    frame.insert(0, "doc_id", ids.iloc[a:b].iloc[frame.pop("at")].to_numpy())
                    yield frame

    return run


def read_templates(table: DataFrame) -> dict[str, str]:
    """The templates of a table (license, text); its size is checked before it is
    read. Of texts with one name the first in order is taken; rows without a name go."""
    named = table.where(F.col("license").isNotNull()).select("license", F.coalesce("text", F.lit("")).alias("text"))
    size = named.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters")).first()
    if size["rows"] > MOST_TEMPLATES or (size["characters"] or 0) > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_TEMPLATES} templates or {MOST_CHARACTERS} characters")
    return {r["license"]: r["text"] for r in named.groupBy("license").agg(F.min("text").alias("text")).collect()}


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """doc_id, license, start_word, end_word and containment of every match."""
    templates = read_templates(templates) if isinstance(templates, DataFrame) else dict(templates)
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    shared = docs.sparkSession.sparkContext.broadcast(templates)
    schema = "doc_id bigint, license string, start_word bigint, end_word bigint, containment double"
    return spread(whole_text(docs, "doc_id")).mapInPandas(_scan(shared), schema)
