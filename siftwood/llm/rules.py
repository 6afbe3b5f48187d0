"""Quality rules: a decision list learned from labelled documents.

``features`` measures whole texts in tasks. ``learn`` covers the rejected
class rule by rule: it grows a conjunction of thresholds by information gain
on two thirds of the labelled rows, prunes it on the other third, keeps it if
it is precise there, and goes on with what no rule covers. The list becomes
one ordered Spark expression, so a verdict costs no Python.

Null texts are empty; a document without words has zeros everywhere. Rows with
equal ids or texts are measured each for itself. Labels null or absent take no
part; with no labelled row of either class the list is empty and keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.llm.frames import small_batches, spread
from siftwood.llm.words import Texts, _is_space, as_bytes, mix, slices, windows

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
# Features a condition may test, as SQL over the counts.
RATIOS = {
    "n_words": "double(n_words)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}

# Learning: at most this many labelled rows (chosen by a hash of the id where
# there are more), thresholds per feature, conditions per rule and rules.
SAMPLE_ROWS = 50_000
THRESHOLDS = 48
CONDITIONS = 4
RULES = 16
PRECISION = 0.9


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_letters_start = (np.arange(256) & 0xC0) != 0x80
_masks = {
    "word_chars": _letters_start & ~_is_space,
    "n_symbols": _mask(SYMBOLS),
    "n_upper": _mask(bytes(range(65, 91))),
    "n_digits": _mask(bytes(range(48, 58))),
    "n_marks": _mask(b"!?.,;:"),
}


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in key order, and for each the first index of its run of equal keys."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(keys) else np.empty(0, bool)
    return order, new


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts of some texts."""
    t = Texts(texts)
    per_text = lambda owners: np.bincount(owners, minlength=t.n).astype(np.int64)
    own = mix(np.arange(1, t.n + 1, dtype=np.uint64))
    hashes, owners, starts = t.words()
    out = {"n_words": per_text(owners)} | {name: t.count(mask) for name, mask in _masks.items()}

    order, new = _copies(hashes ^ own[owners])
    out["n_distinct"] = per_text(owners[order[new]])

    keys, first = windows(hashes, owners, 3)
    order, new = _copies(keys ^ own[owners[first]])
    lone = new & np.r_[new[1:], True] if len(new) else new
    again = np.zeros(len(hashes) + 3, bool)
    again[first[order[~lone]]] = True
    covered = again[:-3].copy()
    covered[1:] |= again[:-4]
    covered[2:] |= again[:-5]
    out["n_repeat_words"] = per_text(owners[covered]) if len(hashes) else np.zeros(t.n, np.int64)

    lines, line_owners, line_starts = t.lines()
    upto = np.r_[line_starts[1:], len(t.data)]
    worded = np.searchsorted(starts, upto) > np.searchsorted(starts, line_starts)
    lines, line_owners = lines[worded], line_owners[worded]
    order, new = _copies(lines ^ own[line_owners])
    out["n_lines"] = per_text(line_owners)
    out["n_dup_lines"] = per_text(line_owners[order[~new]])
    return out


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [as_bytes(x) for x in batch["text"]]
        for a, b in slices(texts):
            yield batch.iloc[a:b].assign(**measure(texts[a:b]))


def _measured_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for measured in _measured(batches):
        yield measured.drop(columns="text")


def features(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (by default doc_id) with COUNTS and MORE of every text."""
    columns = columns or ("doc_id",)
    docs = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns]
    schema = ", ".join(kept + [f"{c} bigint" for c in COUNTS + MORE])
    small_batches(docs.sparkSession)
    return spread(docs).mapInPandas(_measured if "text" in columns else _measured_only, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, list(RATIOS).index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold


Rule = list[Condition]


def _covers(rule: Rule, values: np.ndarray) -> np.ndarray:
    inside = np.ones(len(values), bool)
    for condition in rule:
        inside &= condition.holds(values)
    return inside


def _grow(values: np.ndarray, bad: np.ndarray) -> Rule:
    rule, inside = [], np.ones(len(values), bool)
    while len(rule) < CONDITIONS and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(RATIOS):
            column = values[inside, k]
            order = np.sort(np.unique(np.quantile(column, np.linspace(0, 1, THRESHOLDS))))
            cuts = (order[1:] + order[:-1]) / 2
            at = np.searchsorted(cuts, column, "left")
            below_p = np.cumsum(np.bincount(at[bad[inside]], minlength=len(cuts) + 1))[:-1]
            below_n = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(cuts) + 1))[:-1]
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gains = np.where(p > 0, p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0))), 0)
                if len(gains) and gains.max() > gain:
                    i = int(gains.argmax())
                    best, gain = Condition(name, above, float(cuts[i])), gains[i]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return rule


def _prune(rule: Rule, values: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    """The prefix of a rule that separates best on unseen rows, and its precision there."""
    best, worth, precision = [], -1.0, 0.0
    for n in range(len(rule), 0, -1):
        inside = _covers(rule[:n], values)
        p, q = bad[inside].sum(), (~bad[inside]).sum()
        if p + q and (p - q) / (p + q) > worth:
            best, worth, precision = rule[:n], (p - q) / (p + q), p / (p + q)
    return best, precision


def cover(values: np.ndarray, bad: np.ndarray, prune_part: np.ndarray) -> list[Rule]:
    """Sequential covering of the rows marked bad."""
    rules: list[Rule] = []
    left = np.ones(len(values), bool)
    while len(rules) < RULES:
        grow, held = left & ~prune_part, left & prune_part
        if bad[grow].sum() < 5:
            break
        rule, precision = _prune(_grow(values[grow], bad[grow]), values[held], bad[held])
        if not rule or precision < PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, values)
    return rules


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and _quality of at most about ``sample_rows`` labelled documents."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    n = labels.count()
    if n > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    return labels


def learn(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for what labels with quality 0, from at most about ``sample_rows`` labelled rows."""
    rows = (
        measured.join(sampled(labels, sample_rows), "doc_id")
        .select("_quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("_part"), *[F.expr(c).cast("double").alias(k) for k, c in RATIOS.items()])
        .orderBy("_part", *RATIOS)
        .toPandas()
    )
    values = rows[list(RATIOS)].to_numpy(float).reshape(-1, len(RATIOS))
    return cover(values, rows["_quality"].to_numpy() == 0, rows["_part"].to_numpy() == 0)


def rejected(rules: list[Rule]) -> Column:
    """Number of the first rule (from 1) that covers a row of ``features``, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        inside = F.lit(True)
        for condition in rules[k - 1]:
            inside = inside & condition.column()
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the rejecting one or null) and kept."""
    return measured.withColumns({"base_failed": base_failed(), "rule": rejected(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )
