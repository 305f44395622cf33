"""Language ID and quality: held-out accuracy on the test tables, and edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import langid, quality
from seqloom.llm.queries import QUERIES
from seqloom.llm.shared import table

SF, SMALL_SF = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang == r.lang_pred for r in got if r.held_out and r.lang and r.text]
    assert np.mean(judged) > 0.95


def test_language_rejects_what_it_cannot_know(spark):
    model = langid.train(["the quick brown fox jumps over it all"] * 60 + ["der schnelle braune fuchs springt"] * 60, ["en", "de"] * 0 + ["en"] * 60 + ["de"] * 60)
    rows = [(1, "the brown fox jumps", 1), (2, None, 1), (3, "12 34 !!", 1), (4, "Москва столица России", 1), (5, "", 1), (5, "", 1), (None, "der braune fuchs", 1), (7, "the fox " * 200_000, 1)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert (by[1].lang_pred, by[7].lang_pred, by[None].lang_pred) == ("en", "en", "de") and not by[1].rejected
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (2, 3, 5)) and by[4].rejected
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify_languages(empty).count() == 0
    assert langid.fit_on(empty, "text", "lang", "doc_id") is None


def test_subword_sums_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abé ") for _ in range(n)) for n in (0, 1, 3, 50, 999, 0, 20)]
    model = langid.train(texts * 3, ["x", "y", "x", "y", "x", "y", "x"] * 3, epochs=1)
    whole = model.sums(*quality.text_bytes(pa.array(texts)))
    monkeypatch.setattr(langid, "STEP", 37)
    parts = model.sums(*quality.text_bytes(pa.array(texts)))
    assert np.allclose(whole[0], parts[0], atol=1e-4) and (whole[1] == parts[1]).all()
    assert whole[1].tolist() == [sum(max(0, len(t.encode()) - s + 1) for s in langid.SIZES) for t in texts]


def subwords_by_hand(text):
    out = []
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    for size in langid.SIZES:
        for i in range(len(data) - size + 1):
            h = size
            for b in data[i : i + size]:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % langid.BUCKETS)
    return out


def test_languages_equal_sums_by_hand(spark):
    """The query, against plain Python on the same model: each subword's logits, their mean, the softmax."""
    docs = table(spark, SMALL_SF, "documents")
    model = langid.fit_on(docs.filter(langid.fold("doc_id", langid.FOLDS) != 0), "text", "lang", "doc_id")
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SMALL_SF).collect()}
    for r in docs.collect():
        own = subwords_by_hand(r.text or "")
        z = [sum(model.logits[h][k] for h in own) / max(1, len(own)) + model.bias[k] for k in range(len(model.languages))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        score = max(e) / sum(e) if any(c.isalpha() for c in r.text or "") else 0.0
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4)
        assert got[r.doc_id].lang_pred == (model.languages[int(np.argmax(z))] if score else "und")


def test_sample_has_a_bound(spark):
    rows = spark.createDataFrame([(i % 7, f"{i % 3} " * 100) for i in range(200)] + [(1, "x" * 5000)], "h long, text string")
    got = langid.bounded_rows(rows, 50, 900)
    assert 1 <= len(got) <= 4 and len(set(got)) == len(got) and langid.bounded_rows(rows.limit(0), 5) == []
    assert len(langid.bounded_rows(rows, 1000)) == 22


def test_quality_accuracy(spark):
    got = QUERIES["op4_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.quality for r in got if r.held_out]) > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words here in order", 1) for i in range(30)] + [(i, "%%% *** BAD!! BAD!!", 1) for i in range(30, 60)] + [(60, None, 1), (61, "", 1), (None, "x", 1), (62, "a b " * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 64 and got[60].score == got[61].score
    assert np.mean([got[i].predicted == (i < 30) for i in range(60)]) == 1
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def passages_by_hand(text):
    """Encoder input of each passage, byte by byte."""
    data, kinds, out = text.encode(), quality.kind_of_byte(), []
    words = [(m.start(), m[0].translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for m in re.finditer(rb"[^ \t-\r]+", data)]
    for a in range(0, max(1, len(data)), quality.PASSAGE):
        part = data[a : a + quality.PASSAGE]
        size, x = max(1, len(part)), [0.0] * quality.WIDTH
        for b in part:
            x[kinds[b]] += 1 / size
        own = [k for k, (at, _) in enumerate(words) if a <= at < a + quality.PASSAGE]
        if words:
            n = max(1, len(own))
            for place, lag in ((-4, 1), (-3, 2)):
                x[place] = sum(k >= lag and words[k][1] == words[k - lag][1] for k in own) / n
            x[-2] = n / size
        x[-1] = math.log2(size) / 10
        out.append(x)
    return out


def test_scores_equal_attention_by_hand(spark):
    """The query, against plain Python on the same model: encoding, gates, weights and score of each document."""
    docs, labels = table(spark, SMALL_SF, "documents"), table(spark, SMALL_SF, "labels")
    model = quality.fit_on(docs, labels, "quality", "text", "doc_id", quality.SAMPLE)
    p = {k: v.tolist() for k, v in model.p.items()}
    dot = lambda v, m, j: sum(x * row[j] for x, row in zip(v, m, strict=True))
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, SMALL_SF).collect()}
    some = [r for r in docs.collect() if len(r.text or "") < 6000]
    for r in some:
        hs, es = [], []
        for x in passages_by_hand(r.text or ""):
            x = [(v - m) / s for v, m, s in zip(x, model.mean, model.std, strict=True)]
            h = [math.tanh(dot(x, p["W"], j) + b) for j, b in enumerate(p["b"])]
            gate = [math.tanh(dot(h, p["V"], j)) / (1 + math.exp(-dot(h, p["U"], j))) for j in range(len(p["w"]))]
            hs.append(h)
            es.append(sum(g * w[0] for g, w in zip(gate, p["w"], strict=True)))
        a = [math.exp(e - max(es)) for e in es]
        z = [sum(w * h[j] for w, h in zip(a, hs, strict=True)) / sum(a) for j in range(len(p["b"]))]
        score = 1 / (1 + math.exp(-(sum(x * c[0] for x, c in zip(z, p["c"], strict=True)) + p["d"][0])))
        assert got[r.doc_id].score == pytest.approx(score, abs=2e-6), r.doc_id
    assert len(some) > 100


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, bounds, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    model = quality.AttentionMIL()
    model.fit(x, bounds, y, steps=200)
    assert (model.score(x, bounds) > 0.5).tolist() == [True, False, True]


def test_passages_cover_every_byte():
    x, bounds = quality.passages(pa.array(["a" * 1500, "", None, "É" * 300]))
    assert np.diff(bounds).tolist() == [3, 1, 1, 2]
    assert x[0, 0] == 1 and x[3].sum() == pytest.approx(x[4].sum())


def test_folds(spark):
    got = spark.createDataFrame([(None,), (12,)], "doc_id long").select(langid.fold("doc_id", 5).alias("f")).collect()
    assert [r.f for r in got] == [0, zlib.crc32(b"12") % 5]
    assert F.lit(1) is not None
