"""Neighbours, archives, toxicity, the language model, licenses and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from cases import frame, sentence, texts, words
from pyspark.sql import functions as F

import corpus_pipeline
from siftwood.llm import hmm, licenses, multi_index, queries, toxicity, warc
from siftwood.llm.chains import Chains
from siftwood.llm.frames import crc_share
from siftwood.llm.words import Texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


# --- neighbours ------------------------------------------------------------------


def vectors(spark, rows):
    out = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return out.withColumns({"cell": F.lit("x"), "vec": F.lit("y"), "block": F.lit(1)})


def nearest(points, query, k=10):
    distance = sorted((float(np.sqrt(np.square(p - points[query]).sum())), i) for i, p in points.items() if i != query)
    return [i for _, i in distance[:k]]


@pytest.mark.parametrize("query_block", [1024, 7])
def test_neighbours_find_nine_in_ten_and_measure_exactly(spark, monkeypatch, query_block):
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    points = {i: (centres[i % 30] + 0.4 * rng.normal(size=16)).astype(np.float32).astype(float) for i in range(6000)}
    for i in range(1, 2000, 2):  # a third of all rows are copies
        points[i] = points[1]
    got = multi_index.search(vectors(spark, [(i, p.tolist()) for i, p in points.items()])).toPandas()
    hits = 0
    for query in range(0, 6000, 100):
        own = got[got["query_id"] == query].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        exact = [float(np.sqrt(np.square(points[i] - points[query]).sum())) for i in own["vec_id"]]
        assert np.allclose(own["score"], exact, rtol=0, atol=1e-12)
        assert sorted(zip(own["score"], own["vec_id"], strict=True)) == list(zip(own["score"], own["vec_id"], strict=True))
        hits += len(set(own["vec_id"]) & set(nearest(points, query)))
    assert hits >= 0.9 * 600


def test_odd_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (200, None), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [0.0, 0.0, 0.0])]
    rows += [(6, [1.0, None, 1.0]), (7, [1.0, 2.0]), (8, []), (None, [1.0, 1.0, 1.0]), (9, [1.0, 1.0, 0.0]), (10, [1.0, 1.0, 0.0]), (0, [1.0, 0.0, 0.0])]
    got = multi_index.search(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 9), (0, 2, 10), (0, 3, 100)] + [
        (100, 1, 9), (100, 2, 10), (100, 3, 0), (100, 4, 0)
    ]
    assert multi_index.search(vectors(spark, rows[2:3])).count() == 0
    assert multi_index.search(vectors(spark, rows).limit(0)).count() == 0


# --- archives --------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit("x"), "size": F.lit("y"), "sha1": F.lit(0)})


PAGES = [(5, None, None), (6, "u\r\n x", ""), (2, "http://a", "same"), (3, "http://b", "same"), (9, "é", "é\U0001f600" * 5000)]
PAGES += [(2, "again", "same"), (None, "n", "same"), (None, "n", "lonely"), (12, "http://c", "<p>x</p>\r\n\r\n" * 9)]


def test_pages_survive_the_round_trip(spark):
    folder, listed = warc.write_archives(pages(spark, PAGES).repartition(2), roll=300)
    got = [r.asDict() for r in warc.read_archives(folder, listed).collect()]
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        own = i == first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, len(payload), digest, "response" if own else "revisit", None if own else first))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for *_, h in PAGES}
    small = warc.read_archives(*warc.write_archives(pages(spark, PAGES), least=5), payloads=False)
    assert {r["page_id"] for r in small.where("record_type = 'revisit'").collect()} == set()
    assert warc.read_archives(*warc.write_archives(pages(spark, PAGES).limit(0))).count() == 0


def archive(*records):
    import zstandard

    dictionary = warc.train_dictionary([])
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.dictionary_frame(dictionary) + b"".join(map(packer.compress, records))


def test_damaged_archives_are_refused():
    sound = warc.page_record(1, "http://a", b"payload", warc.sha1_base32(b"payload"), False, "2024-01-01T00:00:00Z")
    assert list(warc.read_frames(io.BytesIO(archive(sound, sound)))) == [sound, sound]
    assert warc.parse_page(*warc.parse_record(sound))["payload"] == b"payload"
    for data in (archive(sound)[:-3], archive(sound)[8:], archive(sound)[:20], b""):
        with pytest.raises(ValueError):
            list(warc.read_frames(io.BytesIO(data)))
    for bad in (sound[:-1], sound.replace(b"WARC/1.1", b"WARC/9.9"), sound.replace(b"WARC-Date: 2024", b"Date: 2024"), sound.replace(b"payload", b"payl0ad"), sound + b"x"):
        with pytest.raises(ValueError):
            warc.parse_page(*warc.parse_record(bad))


# --- chains and the language model ------------------------------------------------


def test_chains_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 4])
    first, moves = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2)
    emission = rng.random((lengths.sum(), 2))
    chains = Chains(lengths)
    laid = chains.laid(emission)
    alpha, scale = chains.forward(laid, moves, first)
    beta = chains.backward(laid, moves, scale)
    moved = chains.moved(alpha, beta, laid, moves, scale)
    likelihoods, marginals, want_moved = [], np.zeros_like(emission), np.zeros((2, 2))
    for a, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            p = first[path[0]] * emission[a, path[0]]
            for t in range(1, n):
                p *= moves[path[t - 1], path[t]] * emission[a + t, path[t]]
            weights[path] = p
        total = sum(weights.values())
        likelihoods.append(math.log(total))
        for path, p in weights.items():
            for t, s in enumerate(path):
                marginals[a + t, s] += p / total
                if t:
                    want_moved[path[t - 1], s] += p / total
    assert np.allclose(chains.sums(np.log(scale)), likelihoods)
    assert np.allclose((alpha * beta)[chains.place], marginals)
    assert np.allclose(moved, want_moved)
    by_state = chains.forward_by_state(laid.T.copy(), moves, first)
    assert np.allclose(by_state[0].T, alpha) and np.allclose(by_state[1], scale)
    gamma, both = chains.marginals_by_state(by_state[0], laid.T.copy(), moves, scale)
    assert np.allclose(gamma.T, alpha * beta) and np.allclose(both, moved)


def test_language_model_counts_and_scores(spark, docs):
    rows = texts()
    held = crc_share("doc_id", 5) == 1
    got = hmm.score_documents(docs, held).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c: dict = {}
    for i, t, *_ in rows:
        for w in [*words(t, fold=True), None] if not is_held(i) else []:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        tokens = [*words(t, fold=True), None]
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((str(i), is_held(i), len(tokens), sum(w in c for w in tokens), n, round(base, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert hmm.score_documents(docs.limit(0), held).count() == 0
    alone = hmm.score_documents(docs.where("doc_id = 4"), F.lit(True)).first()
    assert alone["base_score"] == 0 and alone["n_known"] == 0


def test_score_is_the_exact_likelihood_and_beats_single_words(spark):
    rng = random.Random(8)
    tongues = [["aa", "ab", "ac", "ad"], ["xx", "xy", "xz", "xw"]]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(30)), "en", "a") for i in range(300)]
    packed = hmm.pack(frame(spark, rows), crc_share("doc_id", 5) == 1)
    counted, counts = hmm.count_words(packed)
    blocks = hmm.with_counts(packed, counted)
    model = hmm.train(blocks, counts)
    got = hmm.score(blocks, counts, model).toPandas().set_index("doc_id")
    unseen = got[got["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum() + 0.15 * unseen["n_tokens"].sum()
    assert np.allclose(model.emission.sum(0), 1) and np.allclose(model.moves.sum(1), 1)
    by_word = {}
    for w in sum(tongues, []):
        h = Texts([w.encode()]).words(fold=True)[0].view(np.int64)[0]
        by_word[w] = counts.classes[np.searchsorted(counts.frequent, h)]
    alpha = None
    total = 0.0
    for w in [*rows[7][1].split(), None]:
        e = model.emission[by_word[w] if w else hmm.END]
        alpha = e * (model.first if alpha is None else alpha @ model.moves)
        total += math.log10(alpha.sum())
        alpha = alpha / alpha.sum()
    assert math.isclose(total, got.loc[7, "score"], rel_tol=1e-9)


# --- toxicity ------------------------------------------------------------------------


def test_toxic_words_are_learned_and_located(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        body = sentence(rng, 60).split()
        if i % 5 == 0:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["vilefoo", "vilebar", "nastyqux"]))
        rows.append((i, " ".join(body), "en", "a"))
        labels.append((i, int(i % 5 == 0)))
    docs, held = frame(spark, rows + [(1000, None, None, None), (1001, "", None, None)]), crc_share("doc_id", 4) == 2
    truth = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, truth, held)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.3) == bool(y) for i, y in labels)
    for i, t, *_ in rows[:50:5]:
        found = [t[int(a) : int(b)] for a, b in (s.split(":") for s in got[i]["spans"].split(","))]
        assert all(w in ("vilefoo", "vilebar", "nastyqux") for span in found for w in span.split())
    assert got[1000]["score"] == got[1001]["score"] < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0
    for none in (truth.limit(0), truth.where("toxic = 0")):
        scores = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none, held)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_toxic_words_of_a_small_language_are_learned(spark):
    """One in 26 toxic documents is of the second language; some clean ones hold its word too."""
    rng = random.Random(16)
    rows, labels, bad = [], [], {0: "vilefoo", 1: "malvado"}
    other = [a + b for a in "uno dos tres rio piedra luz agua".split() for b in ["", "s", "ito"]]
    for i in range(2496):
        small = i >= 2400
        body = [rng.choice(other) for _ in range(40)] if small else sentence(rng, 40).split()
        if i % 4 == 0 or (small and i % 16 == 1):
            for _ in range(3 if i % 4 == 0 else 1):
                body.insert(rng.randrange(len(body)), bad[small])
        rows.append((i, " ".join(body), "es" if small else "en", "a"))
        labels.append((i, int(i % 4 == 0)))
    docs, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, truth, crc_share("doc_id", 4) == 2)).collect()}
    for i, t, *_ in rows[2400:]:
        if i % 16 != 1:
            assert (got[i]["score"] >= 0.3) == (i % 4 == 0)
        if i % 4 == 0:
            found = [t[int(a) : int(b)] for a, b in (s.split(":") for s in got[i]["spans"].split(","))]
            assert all(w == "malvado" for span in found for w in span.split())


def test_settings_are_ranked_by_rows_left_out_of_each_fit(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 40) + (" vilest wretches" if i % 4 == 0 else ""), "en", "s") for i in range(160)]
    truth = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 160, 2)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(frame(spark, rows), truth, F.col("doc_id") % 10 == 0)
    assert sample.count() == 64 and {r["toxic"] for r in sample.collect()} == {0, 1}
    blind = toxicity.Settings((50.0, 60.0, 70.0, 80.0), 3, 0.85)
    ranked = toxicity.cross_validate(sample, [blind, toxicity.SETTINGS])
    assert [s for _, s in ranked] == [toxicity.SETTINGS, blind] and ranked[0][0] < ranked[1][0] / 2


def test_scoring_survives_odd_texts(docs):
    nothing = toxicity.Lexicon(np.array([1], np.uint64), np.array([3]))
    field = toxicity.Field(np.zeros((toxicity.N_CODES, 2)), np.zeros((2, 2)))
    got = toxicity.score(docs, toxicity.Model(nothing, field, np.zeros(3))).collect()
    assert len(got) == len(texts()) and {r["score"] for r in got} == {0.5}


# --- licenses ------------------------------------------------------------------------


def plain_matches(text: str, template: str) -> bool:
    def shingles(t):
        import re

        w = re.findall(r"[A-Za-z0-9\x80-\xff]+", t.encode().decode("latin-1").lower())
        return [tuple(w[k : k + licenses.SHINGLE]) for k in range(len(w) - licenses.SHINGLE + 1)]

    wanted, own = set(shingles(template)), shingles(text)
    width = len(wanted) + 8
    return any(len(wanted & set(own[a : a + width])) >= licenses.LEAST * len(wanted) for a in range(max(1, len(own) - len(wanted) + 1)))


def test_licenses_are_found_and_nothing_else(spark, docs):
    rng = random.Random(12)
    rows, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for copy in range(6):
            notice = text.upper() if copy == 1 else text.replace(" ", "\n ") if copy == 2 else text
            if copy == 3 and len(text.split()) > 25:
                notice = " ".join("word" if j == 12 else w for j, w in enumerate(text.split()))
            body = f"{sentence(rng, rng.randrange(200))} {notice} {sentence(rng, rng.randrange(200))}"
            rows.append((k * 10 + copy, body, "en", "a"))
    for i, body, *_ in rows:
        want |= {(i, name) for name, text in licenses.TEMPLATES.items() if plain_matches(body, text)}
    got = licenses.scan(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want
    assert {(k * 10, name) for k, name in enumerate(licenses.TEMPLATES)} <= want
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def license_spans(text: str, templates=licenses.TEMPLATES) -> list[tuple]:
    return [r[1:] for r in licenses.Templates(dict(templates)).matches([text.encode()])]


def test_license_spans_are_exact():
    bsd, n = licenses.TEMPLATES["BSD"], 16
    assert license_spans(bsd) == [("BSD", 0, n, 1.0)]
    assert license_spans(" ".join([bsd] * 3)) == [("BSD", k * n, k * n + n, 1.0) for k in range(3)]
    stray = "redistribution and use in source and binary code words"
    assert license_spans(f"{stray} {bsd} and more") == [("BSD", 9, 9 + n, 1.0)]
    for before in (0, 1, 13, 400, 3000):
        text = " ".join([f"w{k}" for k in range(before)] + [bsd, "x " * 5000, bsd])
        assert license_spans(text) == [("BSD", before, before + n, 1.0), ("BSD", before + n + 5000, before + 2 * n + 5000, 1.0)]
    # Two in a row of a notice of one shingle.
    assert license_spans(licenses.TEMPLATES["MIT"] * 2) == [("MIT", 0, 5, 1.0), ("MIT", 5, 10, 1.0)]


def test_license_parts_in_another_order_and_templates_that_repeat_words():
    words = [f"t{k}" for k in range(60)]
    swapped = " ".join(["a", "b", *words[30:], *words[:30], "c"])
    (found,) = license_spans(swapped, {"L": " ".join(words)})
    assert found[:3] == ("L", 2, 62) and found[3] == 52 / 56
    again = words[:10] + words[5:10] * 2 + words[10:]
    assert license_spans(" ".join(["a", *again, "b", *again]), {"L": " ".join(again)}) == [("L", 1, 71, 1.0), ("L", 72, 142, 1.0)]


def test_license_spans_are_found_wherever_a_plain_window_holds_enough():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))]
        body = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            cut = rng.randrange(len(words))
            body += rng.choice([words, words[cut:] + words[:cut], words[cut:], words[:cut]]) + [rng.choice("abxy")]
        template, text = " ".join(words), " ".join(body)
        found = license_spans(text, {"L": template})
        if plain_matches(text, template):
            assert found
        wanted = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for _, a, b, share in found:
            inside = {tuple(body[k : k + 5]) for k in range(a, b - 4)} & wanted
            assert share == len(inside) / len(wanted) >= licenses.LEAST
            assert tuple(body[a : a + 5]) in wanted and tuple(body[b - 5 : b]) in wanted


def test_license_templates_from_a_table(spark, monkeypatch):
    rows = [("A", "one two three four five six"), ("B", None), (None, "gone"), ("A", "zzz")]
    table = spark.createDataFrame(rows, "license string, text string")
    assert licenses.read_templates(table) == {"A": "one two three four five six", "B": ""}
    docs = frame(spark, [(1, "x one two three four five six", "en", "a")])
    assert [tuple(r) for r in licenses.scan(docs, table).collect()] == [(1, "A", 1, 7, 1.0)]
    assert licenses.scan(docs, table.limit(0)).count() == 0
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 1)
    with pytest.raises(ValueError):
        licenses.scan(docs, table)


def test_one_row_of_each_group_stays(spark):
    """Rows of one id are told apart by their texts; texts without words are linked with nothing."""
    rng = random.Random(21)
    copied, near, own, other = (sentence(rng, 90) for _ in range(4))
    rows = [(3, copied), (7, copied.upper()), (7, own), (9, other), (9, other), (11, near), (11, near + " end")]
    rows += [(None, ""), (None, ""), (None, None), (5, " \n"), (5, "")]
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows]).select(*corpus_pipeline.COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()]
    nears = [row for row in got if row[0] == 11]
    assert len(nears) == 1 and nears[0] in rows
    want = [(3, copied), (7, own), (9, other), *nears, *rows[7:]]
    assert sorted(got, key=str) == sorted(want, key=str)


# --- registration and pipeline ----------------------------------------------------------


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["quality_rules", "ngram_jaccard_join"]


def test_pipeline_stages_take_effect(spark):
    from siftwood.cluster import materialise

    rng = random.Random(5)
    rows = []
    for i in range(300):
        body = sentence(rng, rng.randrange(60, 120)) + f" unique{i} marks{i} here{i} {i}@mail.example.com"
        rows.append((i, body, "en", f"s{i % 3}"))
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(40)] + [(2000, None, "en", "s1"), (2001, "short", "en", None)]
    docs, columns = frame(spark, rows).select(*corpus_pipeline.COLUMNS), corpus_pipeline.COLUMNS
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), "stage")
        seen.append((name, docs.count()))
        if name == "ngram_jaccard_join":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= set(range(300))
        if name == "personal_data":
            assert docs.where("text LIKE '%@mail%'").count() == 0 and docs.where("text LIKE '%<EMAIL>%'").count() > 0
        if name != "bpe":
            assert docs.columns == columns
    sizes = [n for _, n in seen]
    assert sizes[0] <= 340 and sizes[1] <= 300 and sizes[2] == sizes[1] and sizes[3] >= 1 and sizes[4] == sizes[3]
