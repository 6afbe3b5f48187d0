"""Quality rules, Jaccard join, mixing, personal data and encoding against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from cases import WORD, frame, sentence, texts, words

from siftwood.llm import bpe, jaccard, mixing, pii, queries, rules

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def rows():
    return texts()


# --- quality rules -------------------------------------------------------------


def counts_of(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs, rows):
    got = rules.features(docs, "doc_id").select("doc_id", *rules.COUNTS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *counts_of(t)) for i, t, *_ in rows), key=str)


def test_workers_get_few_texts_at_once(spark, tmp_path):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", [(i, f"a{i} " + "b" * (1 << 20)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).coalesce(1)
    spark.conf.unset(key)
    rules.features(docs).collect()
    sizes = docs.mapInPandas(lambda batches: (b.head(1).assign(text=str(len(b))) for b in batches), docs.schema)
    assert max(int(r["text"]) for r in sizes.collect()) <= 9


def test_rules_learn_a_threshold_and_need_both_classes(spark):
    rng = random.Random(2)
    good = [(i, sentence(rng, 80), "en", "a") for i in range(60)]
    bad = [(100 + i, " ".join(w + "##" for w in sentence(rng, 80).split()), "en", "a") for i in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in good + bad] + [(None, 0), (5, None)], "doc_id long, quality int")
    measured = rules.features(docs)
    learned = rules.learn(measured, labels)
    verdict = {r["doc_id"]: r["kept"] for r in rules.judge(measured, learned).collect()}
    assert all(verdict[i] == (i < 100) for i in verdict)
    assert rules.learn(measured, labels.where("quality = 1")) == []
    assert rules.features(docs.limit(0)).count() == 0
    assert rules.learn(measured, labels.limit(0)) == []


def test_base_rule_rejects_repeats_and_short_texts(docs):
    judged = rules.judge(rules.features(docs), []).where("base_failed").select("doc_id").collect()
    assert {r[0] for r in judged} >= {1, 2, 3, 4, 9, 11, 12}


# --- Jaccard join ----------------------------------------------------------------


def components_of(rows, gram=4, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = words(t, fold=True)
        sets.append({tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    name = {}
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            name[g] = min(i, name.get(g, i))
    return sorted(((i, len(s), name.get(g)) for (i, *_), s, g in zip(rows, sets, group, strict=True)), key=str)


def joined(docs):
    return sorted(map(tuple, jaccard.linked_documents(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join_equals_brute_force(docs, rows):
    assert joined(docs) == components_of(rows)


@pytest.mark.parametrize("heavy, parts", [(64, 2048), (2, 8)])
def test_join_of_groups_with_shared_passages(spark, monkeypatch, heavy, parts):
    """Chains of near copies and a passage in many texts; also with every bucket heavy and blocks cut."""
    rng = random.Random(7)
    passage = sentence(rng, 25)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice([12, 60, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy) + (" " + passage if rng.random() < 0.5 else ""), "en", "a"))
    rows += [(1000 + k, passage if k < 3 else f"{passage} own{k} words{k} here{k}", "en", "a") for k in range(9)]
    monkeypatch.setattr(jaccard, "HEAVY_DOCS", heavy)
    monkeypatch.setattr(jaccard, "STAR_DOCS", 8 * heavy)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", parts)
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 50)
    assert joined(frame(spark, rows)) == components_of(rows)


def test_join_writes_no_prefixes_and_hands_on_heavy_stars_by_document(spark, monkeypatch):
    rng = random.Random(8)
    passage = sentence(rng, 30)
    rows = [(k, passage + "".join(f" z{k}y{i}" for i in range(k % 3)), "en", "a") for k in range(60)]
    rows += [(100 + k, sentence(rng, 40), "en", "a") for k in range(20)]
    written, write, dealt, deal = [], jaccard.materialise, [], jaccard._candidates

    def told(df, label):
        written.append(label)
        return write(df, label)

    def counted(prefixes):
        dealt.append(sorted(map(tuple, prefixes.where("heavy").select("sig", "gram").distinct().collect())))
        out = deal(prefixes)
        assert set(dealt[0]) <= set(map(tuple, out.collect())) and dealt[0]
        return out

    monkeypatch.setattr(jaccard, "HEAVY_DOCS", 2)
    monkeypatch.setattr(jaccard, "materialise", told)
    monkeypatch.setattr(jaccard, "_candidates", counted)
    assert joined(frame(spark, rows)) == components_of(rows)
    assert "prefixes" not in written


def test_join_of_nothing(docs):
    assert jaccard.linked_documents(docs.limit(0)).count() == 0


# --- mixing ------------------------------------------------------------------------


def targets_of(sizes):
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(weight[s] for s in open_)
        left = budget - sum(target.values())
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_meets_targets(docs, rows):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = targets_of(sizes)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in rows)
    assert {round(r["target"], 6) for r in got} == {round(x, 6) for x in want.values()}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = [r.asDict() for r in mixing.mix(docs.repartition(5)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_nears_each_target(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    got = mixing.mix(frame(spark, rows)).collect()
    source = {i: s for i, _, _, s in rows}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_mix_of_nothing_and_of_empty_texts(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("text IS NULL OR text = ''")).collect()} == {0}


# --- personal data -------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            bad = (
                (kind == "ip" and any(int(x) > 255 for x in m.group().split(".")))
                or (kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)))
                or (kind == "phone" and not 10 <= len(digits) <= 15)
            )
            if not bad:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


ODD = [
    "a@b.c_d@e.f x@y..z@q.r a@.b@c.d a@b a@b.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 0.0.0.0 999999999999999999999999.1.1.1",
    "+1 (017) 555-7713) +1+2 +123 4539 1488 0343 6467-4539148803436467",
    "é\U0001f600 x@y.zz 4539148803436467 \U0001d518 +1 2345678901",
    "e@f.g," * 700 + " 4539148803436467",
    "x" * 30_000 + "@a.b " + "1" * 20_000 + " a@" + "b." * 20_000 + "c",
]


def test_base_spans_equal_brute_force(spark, docs, rows):
    more = [(100 + i, t, None, None) for i, t in enumerate(ODD)]
    got = pii.digest(frame(spark, rows + more)).collect()
    want = [(i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t, *_ in rows + more]
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    mail = next(r for r in got if r["doc_id"] == 8)
    assert (mail["n_email"], mail["n_ip"], mail["n_phone"], mail["n_card"]) == (1, 1, 1, 0)
    assert pii.digest(docs.limit(0)).count() == 0


def test_secrets_are_added_and_redacted(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        plain = f"{sentence(rng, 12)} chapter-{i} 2024-01-{i % 28 + 1:02d}-report {sentence(rng, 5)}"
        rows.append((i, f'{plain} token = "{secret}" end' if i % 2 else plain, "en", "a"))
    docs = frame(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}
    for i, t, *_ in rows:
        if i % 2:
            kind, a, b = spans[i].split(":")
            assert kind == "secret" and re.fullmatch("[0-9a-f]{40}", t[int(a) : int(b)])
        else:
            assert spans[i] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert all(("<SECRET>" in r["text"]) == bool(r["doc_id"] % 2) for r in clean.collect())


# --- byte-pair encoding ---------------------------------------------------------------


def test_texts_with_long_runs_are_told_exactly(spark):
    rng = random.Random(31)
    letters = ["a", "é", "日", "😀", "-"]
    rows = []
    for k in range(400):
        body = ""
        for _ in range(rng.randrange(4)):
            body += rng.choice(letters) * rng.choice([1, 30, 48, 49, 50, 51, 75, 120]) + rng.choice([*bpe.WHITE, ""])
        rows.append((k, body, "en", "a"))
    for run in (1, 2, 49, 50, 51):
        found = {r["doc_id"] for r in frame(spark, rows).where(bpe.unsplit(run)).collect()}
        assert found == {k for k, body, *_ in rows if re.search(f"[^{bpe.WHITE}]{{{run}}}", body)}


def test_encoding_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    spec = queries.tokenizer_file()
    library = Tokenizer.from_str(spec)
    rng = random.Random(5)
    more = [
        "l'été d'où we'll I'VE 'S <|<|endoftext|>|> ŉ İ ΑΣ ê̈ ª º ² µ \x1c\x85z​q",
        "".join(rng.choice("thean") for _ in range(40_000)) + " tail, " + "!" * 30_000,
        "日本語" * 9000 + "1" * 5000 + "x" * 17_000 + "<|startoftext|>" + "é" * 20_000,
    ]
    rows = rows + [(100 + i, t, None, None) for i, t in enumerate(more)]
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append((i, len(ids), packed, decoded))
    frame_ = frame(spark, rows)
    assert sorted(map(tuple, bpe.digest(frame_, spec).collect()), key=str) == sorted(want, key=str)
    small = bpe.encode(frame_, spec, run=50, leaf=7)
    got = sorted(((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest()) for r in small.collect()), key=str)
    assert got == sorted(((i, h) for i, _, h, _ in want), key=str)
    assert bpe.digest(docs.limit(0), spec).count() == 0


def test_every_latin_character_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    spec = queries.tokenizer_file()
    library, encoder = Tokenizer.from_str(spec), bpe.Encoder(spec)
    for c in map(chr, range(0x21, 0x250)):
        for text in (c, f"{c}liyev", f"a{c}'s", f"x{c.lower()}{c}1"):
            assert encoder.encode(text) == encoder.pack(library.encode(text, add_special_tokens=False).ids), text


def test_joins_agree_with_whole_encoding():
    encoder = bpe.Encoder(queries.tokenizer_file())
    rng = random.Random(9)
    for n in (2, 3, 10, 500, 3000):
        for letters in ("ab", "thing", "aaaaab"):
            piece = "".join(rng.choice(letters) for _ in range(n))
            leaves = [encoder.merge(x) for x in encoder.leaves(piece, rng.randrange(1, 40))]
            assert encoder.tree(leaves) == encoder.merge(encoder.symbols(piece))
