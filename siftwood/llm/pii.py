"""Personal data: patterns, and a span classifier learned from weak labels.

Four patterns give the base spans. Further candidates, long runs of letters
and digits, get votes from labelers: a shape pattern, a gazetteer of prefixes
and known harmless names, the words before, and how often digits turn to letters. Votes are
counted by pattern over all documents; expectation-maximisation turns the counts
into a reliability per labeler and a probability per vote pattern. A logistic
classifier of bucketed span features is trained on those probabilities, again
from counts, and adds the spans it finds likely. Base spans always stay.

All is SQL functions; only counts of at most 3**4 vote patterns and FEATURES
combinations reach the driver. Offsets are code points, ends exclusive. Patterns
don't backtrack into what they have read, so long runs cost linear time.
Null texts are empty; every row, with or without an id, is judged by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm.frames import spread

# Kinds in the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before a pattern is tried.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+"
BEFORE = 24
STEP = 256

# Labelers' fixed lists.
SECRET_PREFIXES = ["sk-", "pk-", "ghp_", "gho_", "AKIA", "ASIA", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-"]
HARMLESS = ["utf-8", "sha-256", "iso-8859", "covid-19", "mp3", "mp4", "x86_64"]
CUES = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|bearer|auth|credential|iban|ssn)[^A-Za-z0-9]{0,6}$"
HARMLESS_CUES = r"(?i)(?:version|page|chapter|figure|table|isbn|doi|commit|build|total)[^A-Za-z0-9]{0,6}$"
SHAPE = r"^(?:[0-9A-Fa-f]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[A-Za-z0-9_+/=-]{32,})$"
HARMLESS_SHAPE = r"^(?:[A-Za-z]+[0-9]{1,4}|[0-9]{1,4}(?:-[0-9]{1,4})+|[-_=+/]*[0-9]{1,4}[-_=+/]*)$"
VOTES = ["shape", "gazetteer", "context", "characters"]
# Span features and the number of buckets of each.
FEATURES = {"length": 6, "digits": 5, "distinct": 5, "upper": 3, "cue": 3}
ROUNDS = 40
LIKELY = 0.5


def spans(text: Column, found: Column, gaps: Column) -> Column:
    """Start, end and text of each match, from the matches and the text between
    them. Running sums go by blocks of STEP, so many matches stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(found) / STEP).cast("int")),
        lambda b: total(F.slice(lengths, b * STEP + 1, F.lit(STEP))),
    )

    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        before = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(lengths, block * STEP + 1, i - block * STEP))
        start = before + F.length(F.get(gaps, i))
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("value"))

    return F.when(F.size(found) > 0, F.transform(found, span))


def _with_spans(docs: DataFrame, name: str, pattern: str, hint: Column) -> DataFrame:
    text = F.col("text")
    found = docs.withColumn(f"_m_{name}", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    matched = F.size(f"_m_{name}") > 0
    found = found.withColumn(f"_g_{name}", F.when(matched, F.split(text, pattern, -1)))
    all_spans = F.coalesce(spans(text, F.col(f"_m_{name}"), F.col(f"_g_{name}")), F.array())
    kind = "array<struct<start:int,end:int,value:string>>"
    return found.withColumn(f"_{name}", all_spans.cast(kind)).drop(f"_m_{name}", f"_g_{name}")


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), _above_255)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _above_255(part: Column) -> Column:
    significant = F.regexp_replace(part, "^0++", "")
    return (F.length(significant) > 3) | (F.coalesce(significant.try_cast("int"), F.lit(0)) > 255)


def _placed(kind: str) -> Column:
    at = F.lit(KINDS.index(kind))
    found = F.filter(f"_{kind}", lambda s: _valid(kind, s["value"]))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), at.alias("kind"), s["end"].alias("end")))


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of documents with base, their base spans (start, kind, end) in
    order, and candidates (start, end, value, before) outside of them."""
    docs = spread(docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text")))
    for kind, pattern in PATTERNS.items():
        docs = _with_spans(docs, kind, pattern, HINTS[kind](F.col("text")))
    docs = _with_spans(docs, "more", CANDIDATE, F.col("text").rlike("[0-9]"))
    docs = docs.withColumn("base", F.array_sort(F.concat(*[_placed(k) for k in PATTERNS])))
    free = F.filter("_more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    digits = lambda c: F.length(F.regexp_replace(c["value"], "[^0-9]", ""))
    free = F.filter(free, lambda c: (digits(c) >= 4) & c["value"].rlike("[A-Za-z]"))
    more = F.transform(
        free,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["value"].alias("value"),
            F.substring(F.col("text"), F.greatest(c["start"] - BEFORE, F.lit(0)) + 1, F.least(c["start"], F.lit(BEFORE))).alias("before"),
        ),
    )
    return docs.withColumn("candidates", more).select(*columns, "text", "base", "candidates")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def votes(value: Column, before: Column) -> dict[str, Column]:
    """Per labeler 0 for harmless, 1 for no opinion, 2 for personal."""
    turns = F.regexp_count(value, F.lit("[0-9][A-Za-z]"))
    starts = lambda names: F.coalesce(*[F.when(F.startswith(value, F.lit(n)), True) for n in names], F.lit(False))
    known = F.lower(value).isin([n.lower() for n in HARMLESS])
    return {
        "shape": _vote(value.rlike(SHAPE), value.rlike(HARMLESS_SHAPE)),
        "gazetteer": _vote(starts(SECRET_PREFIXES), known),
        "context": _vote(before.rlike(CUES), before.rlike(HARMLESS_CUES)),
        "characters": _vote(turns >= 3, turns <= 1),
    }


def span_features(value: Column, before: Column) -> dict[str, Column]:
    """Bucket of each of FEATURES."""
    share = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)
    bucket = lambda x, top: F.least(F.floor(x), F.lit(top)).cast("int")
    return {
        "length": bucket(F.log2(F.length(value) / 8.0), 5),
        "digits": bucket(share("0-9") * 5, 4),
        "distinct": bucket(F.size(F.array_distinct(F.split(value, ""))) / 4, 4),
        "upper": F.when(share("A-Z") == 0, 0).when(share("a-z") == 0, 1).otherwise(2),
        "cue": _vote(before.rlike(CUES), before.rlike(HARMLESS_CUES)),
    }


def reliabilities(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """The probability that a span of each vote pattern is personal, by
    expectation-maximisation over the patterns' counts from a majority start."""
    post = {v: 1 / (1 + math.exp(-2.0 * sum(x - 1 for x in v))) for v in counts}
    for _ in range(ROUNDS):
        mass = [1.0, 1.0]
        seen = [[[1.0] * 3 for _ in VOTES] for _ in range(2)]
        for v, n in counts.items():
            for truth, p in ((1, post[v]), (0, 1 - post[v])):
                mass[truth] += n * p
                for j, x in enumerate(v):
                    seen[truth][j][x] += n * p
        for v in counts:
            logs = [
                math.log(mass[t] / sum(mass)) + sum(math.log(seen[t][j][x] / sum(seen[t][j])) for j, x in enumerate(v))
                for t in (0, 1)
            ]
            post[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))
    return post


def fit(rows: Sequence[tuple[tuple[int, ...], float, float]]) -> tuple[float, dict[str, list[float]]]:
    """Weights of a logistic model of bucketed features, from (buckets, summed
    probability, count); full-batch gradient steps."""
    weights = {name: [0.0] * n for name, n in FEATURES.items()}
    bias, total = 0.0, sum(n for _, _, n in rows) or 1.0
    for _ in range(300):
        step = {name: [0.0] * n for name, n in FEATURES.items()}
        shift = 0.0
        for buckets, p, n in rows:
            z = bias + sum(weights[name][b] for name, b in zip(FEATURES, buckets, strict=True))
            error = (p - n / (1 + math.exp(max(-60.0, min(60.0, -z))))) / total
            shift += error
            for name, b in zip(FEATURES, buckets, strict=True):
                step[name][b] += error
        bias += 2.0 * shift
        for name, values in step.items():
            weights[name] = [w + 2.0 * (s - 1e-5 * w) for w, s in zip(weights[name], values, strict=True)]
    return bias, weights


def train(found: DataFrame) -> tuple[float, dict[str, list[float]]]:
    """The span classifier, from all candidates of ``located``."""
    spans_ = found.select(F.explode("candidates").alias("c")).select("c.value", "c.before")
    value, before = F.col("value"), F.col("before")
    labelled = spans_.select(*[c.alias(f"v_{k}") for k, c in votes(value, before).items()], *[c.alias(k) for k, c in span_features(value, before).items()])
    rows = labelled.groupBy(*labelled.columns).count().collect()
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        v = tuple(r[f"v_{k}"] for k in VOTES)
        counts[v] = counts.get(v, 0) + r["count"]
    post = reliabilities(counts)
    sums: dict[tuple[int, ...], list[float]] = {}
    for r in rows:
        s = sums.setdefault(tuple(r[k] for k in FEATURES), [0.0, 0.0])
        s[0] += post[tuple(r[f"v_{k}"] for k in VOTES)] * r["count"]
        s[1] += r["count"]
    return fit([(k, p, n) for k, (p, n) in sorted(sums.items())])


def likelihood(value: Column, before: Column, model: tuple[float, dict[str, list[float]]]) -> Column:
    bias, weights = model
    z = F.lit(bias)
    for name, bucket in span_features(value, before).items():
        z = z + F.get(F.array(*[F.lit(w) for w in weights[name]]), bucket)
    return 1 / (1 + F.exp(-z))


def detect(found: DataFrame, model: tuple[float, dict[str, list[float]]]) -> DataFrame:
    """Adds spans, base and classified ones (start, kind, end) in order, to ``located`` rows."""
    likely = F.filter("candidates", lambda c: likelihood(c["value"], c["before"], model) >= LIKELY)
    more = F.transform(likely, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("secret")).alias("kind"), c["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat("base", more)))


def listed(spans_: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == KINDS.index(kind)


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each document."""
    found = materialise(located(docs, "doc_id").drop("text"), "spans")
    detected = detect(found, train(found))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in PATTERNS]
    return detected.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans
    become one replacement for the first and none for what another adds."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.get(names, s["kind"]))
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], fresh)).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    finish = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text) - done["at"]))
    return F.when(F.size(spans_) == 0, text).otherwise(F.aggregate(spans_, start, step, finish))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, null texts as empty; other columns as they are."""
    # Other columns travel in one, so that none can clash.
    others = F.struct(*[c for c in docs.columns if c != "text"], F.lit(0).alias("_"))
    packed = docs.select(others.alias("others"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(located(packed, "others"), "located")
    clean = redacted(F.col("text"), F.col("spans"))
    detected = detect(found, train(found)).withColumn("text", clean)
    return detected.select(*[F.col(c) if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])
