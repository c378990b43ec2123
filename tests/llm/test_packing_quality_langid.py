"""Packing, quality and language: brute force, held-out accuracy and odd rows."""

import struct
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataframe.llm import langid, packing, quality

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
DOCS = "doc_id long, text string, lang string, score string, ids int, n int"
ODD = [(1, None, "en", "x", 1, 1), (1, None, "en", "x", 1, 1), (None, "", None, None, None, None), (3, "Hello, World! it's 漢字 <|endoftext|> \x85é", "en", "", 2, 3), (4, "a b " * 9000, "en", None, 0, 0), (4, "!!! 123", "de", None, 0, 0)]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, docs):
    by_sequence, tokens = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        tokens.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
    want = {}
    for key, text in docs:
        want.setdefault(key, []).append(ids_of(text))
    for key, texts in want.items():
        assert sum(r["length"] for r in tokens[key]) == sum(map(len, texts))
        for r in tokens[key]:
            parts = [x[r["start"] : r["start"] + r["length"]] for x in texts if len(x) == r["doc_tokens"]]
            assert any(zlib.crc32(struct.pack(f"<{len(x)}I", *x)) == r["ids_crc32"] for x in parts)
    return by_sequence


def test_packing(spark, sf):
    rows = [r.asDict() for r in packing.op1_packing(spark, sf).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    by = check_pieces(rows, docs)
    total = sum(r["length"] for r in rows)
    padding = sum(4096 - n for x in by.values() if (n := sum(r["length"] for r in x)) & (n - 1))
    assert padding <= 0.02 * total + 4096


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    check_pieces([r.asDict() for r in packing.digest(docs, PATH).collect()], [(r[0], r[1]) for r in ODD])
    assert packing.digest(docs.limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=[chr(i) for i in range(256)], max_size=80))
def test_ids(text):
    assert np.frombuffer(packing.parts_of(PATH).ids([text])[0], "<u2").tolist() == ids_of(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 500), max_size=40))
def test_plan_places_every_document(lengths):
    histogram = {}
    for n, c in lengths.items():
        b = packing.bin_of(n, 4096)
        histogram[b] = histogram.get(b, 0) + c
    placed = {}
    for made, n in packing.plan(histogram):
        assert sum(b * k for b, k in made) <= 4096
        for b, k in made:
            placed[b] = placed.get(b, 0) + n * k
    assert placed == histogram


def test_nnls_fits():
    parts = packing.combinations(4096)
    rng = np.random.default_rng(1)
    x = np.zeros(len(parts))
    x[rng.choice(len(parts), 40, replace=False)] = rng.integers(1, 50, 40)
    target = np.zeros(513)
    for p, c in zip(parts, x):
        for u in p[p > 0]:
            target[u] += c
    got = packing.nnls(parts, target)
    back = np.zeros(513)
    for p, c in zip(parts, got):
        for u in p[p > 0]:
            back[u] += c
    assert (got >= 0).all() and np.abs(back - target).sum() <= 0.02 * target.sum()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op2_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(rows[d], q) for d, q in labels if rows[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    assert np.mean([r.predicted == q for r, q in held]) >= 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, 0), (1, None)], "doc_id long, quality int")
    ranker = quality.train(docs, labels)
    out = quality.score(docs, ranker, keep=True).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    for some in (labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        got = {round(r.score, 3) for r in quality.score(docs, quality.train(docs, some)).collect()}
        assert got == ({0.1} if some.where("quality = 0").count() else {0.5})
    assert quality.score(docs.limit(0), ranker).count() == 0


def test_quality_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scores = lambda d, l: {r.doc_id: r.score for r in quality.score(d, quality.train(d, l)).collect()}  # noqa: E731, E741
    assert scores(docs, labels) == scores(docs.repartition(7), labels.repartition(5).unionByName(labels.limit(40)))


def test_pairwise_fit_by_brute_force():
    """The same loss over the same pairs, minimised pair by pair in plain Python."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    good = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=40) > 0
    r = quality.fit(x, good, pairs=400, steps=150)
    b = np.clip((np.concatenate([x, *(np.maximum(x - k, 0) for k in r.knots), x > 0], axis=1) - r.mean) / r.scale, -20, 20)
    drawn = np.random.default_rng(7)
    i, j = drawn.choice(np.flatnonzero(good), 400), drawn.choice(np.flatnonzero(~good), 400)
    w, v = [0.0] * b.shape[1], [0.0] * b.shape[1]
    for step in range(150):
        g = [1e-3 * a for a in w]
        for a, c in zip(i, j):
            d = b[a] - b[c]
            p = 1 / (1 + math.exp(float(d @ w)))
            g = [y - p * z / 400 for y, z in zip(g, d)]
        v = [0.9 * y - (0.3 if step < 75 else 0.1) * z for y, z in zip(v, g)]
        w = [y + z for y, z in zip(w, v)]
    assert np.allclose(r.weights, w, atol=1e-6)
    s = sorted(float(y) for y in b @ np.array(w))
    cut = int((~good).sum())
    assert r.threshold == pytest.approx((s[cut - 1] + s[cut]) / 2, abs=1e-6)


def pair_loss(r, x, good, w, l2=1e-3):
    """Mean loss and gradient over all pairs, pair by pair."""
    b = np.clip(r.basis(x), -20, 20)
    s = b @ w
    d = s[~good][None] - s[good][:, None]
    p = 1 / (1 + np.exp(-d)) / d.size
    return np.logaddexp(0, d).mean() + l2 / 2 * w @ w, p.sum(axis=0) @ b[~good] - p.sum(axis=1) @ b[good] + l2 * w


def test_all_pairs_by_brute_force():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 3)).astype(np.float32)
    good = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=90) > 0
    r = quality.fit(x, good)
    assert np.allclose(r.knots, np.quantile(x.astype(float), quality.KNOTS, axis=0), atol=1e-6)
    w = np.zeros_like(r.weights)
    for _ in range(20000):
        w -= 0.2 * pair_loss(r, x, good, w)[1]
    best = pair_loss(r, x, good, w)[0]
    assert best - 1e-6 <= pair_loss(r, x, good, r.weights)[0] <= best * 1.002
    s = np.sort(np.clip(r.basis(x), -20, 20) @ r.weights)
    cut = int((~good).sum())
    assert s[cut - 1] <= r.threshold <= s[cut]


def test_every_labelled_row_teaches(spark):
    """More rows than the 20,000 that taught before: the table's model is that of all rows in memory."""
    rng = np.random.default_rng(2)
    words = ["the", "of", "Cat", "dogs", "###", "a1", "xyz.", "THE", "\n", "e"]
    texts = [" ".join(rng.choice(words, 1 + i % 7)) for i in range(21_000)]
    good = [(t.count("e") + i % 3) > 2 for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    blocks = quality.labelled(quality.featured(docs), labels).collect()
    assert sum(len(b.preferred) for b in blocks) == 21_000 and len({b.block for b in blocks}) == len(blocks) > 5
    one, two = quality.train(docs, labels), quality.fit(np.array([quality.features(t) for t in texts]), np.array(good))
    assert np.array_equal(one.knots, two.knots) and np.allclose(one.mean, two.mean) and np.allclose(one.weights, two.weights, atol=1e-3)
    assert one.threshold == pytest.approx(two.threshold, abs=1e-2)


def test_places(spark):
    from strataframe.llm.common import at_places

    rng = np.random.default_rng(1)
    values = {"a": [*rng.normal(size=900), 1e9, -1e9], None: [3.0] * 50 + [4.0], "b": [0.25]}
    rows = [(g, float(v)) for g, x in values.items() for v in x]
    places = lambda n: [0, 0.37 * (n - 1), n / 2, n - 1]
    got = at_places(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], places)
    for g, x in values.items():
        assert np.allclose(got[g,], np.interp(places(len(x)), np.arange(len(x)), np.sort(x)), rtol=1e-12, atol=0)
    assert at_places(spark.createDataFrame([], "g string, v double"), ["g"], places) == {}


def test_languages_change_inside_runs(spark):
    learn = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog were there with them", "en"), ("日本語の文章です", "ja"), ("кот и собаки были там", "ru")] * 5)]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "日本語の文章ですthere were the dogs and the cats"), (2, "cтам были собаки")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.label(rows, model).collect()}
    assert [s.lang for s in got[1].spans] == ["ja", "en"] and got[2].lang_pred == "ru"
    assert langid.LETTERS.findall("日本語English") == ["日本語", "English"] and max(map(len, langid.LETTERS.findall("漢" * 50))) == langid.SHORT


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op6_language_id(spark, sf).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_spans(spark):
    learn = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog were there with them", "en"), ("der hund und die katze waren nicht hier", "de"), ("кот и собака были там", "ru"), ("x", None)] * 3)]
    docs = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    model = langid.train(docs)
    mixed = [(1, "the dog and the cat were there. der hund und die katze waren nicht hier"), (2, "и собака 12"), (3, None), (4, "12 !!"), (5, "")]
    rows = {r.doc_id: r for r in langid.label(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in rows[1].spans] == ["en", "de"] and rows[1].spans[1].first == 7 and rows[1].spans[1].words == 8
    assert rows[2].lang_pred == "ru" and [rows[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    odd = langid.label(spark.createDataFrame(ODD, DOCS), langid.train(docs.limit(0)))
    assert {r.lang_pred for r in odd.collect()} == {"und"} and odd.count() == len(ODD)
    assert langid.label(docs.limit(0), model).count() == 0


def test_viterbi_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1, 5])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    path, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        own = scores[at : at + n]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert not n or value(path[at : at + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))
        at += n
