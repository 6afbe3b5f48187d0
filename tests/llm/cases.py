"""Small tables with everything that may trouble an operator."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside; a table may have them as well.
CLASHING = ["key", "size", "hash", "n", "sig", "ids", "held", "times", "name", "base", "spans", "score", "gram", "block", "words", "row"]


_words = [a + b for a in "the of and to in river stone light water cloud paper green".split() for b in ["", "s", "ing", "er", "."]]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(_words) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empties, long runs, copies, repeated ids and rows."""
    rng = random.Random(4)
    base = sentence(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \n\t ", "en", ""),
        (4, "word", "en", "a"),
        (5, base, "en", "a"),
        (6, " ".join(near), "en", None),
        (7, base.upper(), "en", "b"),
        (7, base.upper(), "en", "b"),
        (8, sentence(rng, 40) + "\nmail a.b@c.example.com or 10.0.0.255, token = \"9f8e7d6c5b4a39281706f5e4\" +1 (222) 333-4444", "en", "b"),
        (9, "x" * 30_000, "en", "c"),
        (10, sentence(rng, 20_000), "en", "c"),
        (11, "ÀÉ日本語 \U0001d518 ‎\x00 <|endoftext|> 4539 1488 0343 6467", "fr", "d"),
        (12, "same line\n" * 60, "en", "d"),
        (None, base, "en", "a"),
        (None, "nobody's text " * 30, None, None),
        (None, "nobody's text " * 30, None, None),
        (13, sentence(rng, 120), "en", "e"),
    ]
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    full = [(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows]
    out = spark.createDataFrame(full, SCHEMA).repartition(3)
    return out.withColumns({c: F.lit("clash") for c in CLASHING})


def words(text: str | None, fold: bool = False) -> list[str]:
    text = text or ""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text) if fold else text)
