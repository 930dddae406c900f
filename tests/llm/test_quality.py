"""The quality classifier: held-out accuracy, sparse dot products against a plain count, awkward inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from metaloom.llm import quality
from metaloom.llm.shared import table

DOC = "doc_id long, text string, lang string, source string, score double, predicted string"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    return docs, labels, {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}


def test_held_out_documents_are_told_apart(scored):
    docs, labels, got = scored
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == q for r, q in held]) > 0.96
    assert np.mean([r.predicted for r, q in held if q]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_labels_held_out_are_not_learnt(spark, scored):
    docs, labels, got = scored
    turned = labels.withColumn("quality", (quality.remainder(labels.doc_id) == 0).cast("int") * (1 - labels.quality) + (quality.remainder(labels.doc_id) != 0).cast("int") * labels.quality)
    kept = {r.doc_id: r.score for r in quality.score_quality(docs, turned).collect()}
    logit = lambda p: np.log(p / (1 - p))
    moved = [logit(kept[i]) - logit(r.score) for i, r in got.items() if 1e-6 < r.score < 1 - 1e-6]
    assert np.ptp(moved) < 1e-6  # the share of good labels may move the bias, nothing else moves


def slow_features(text):
    words = (text or "").split()
    if not words:
        return {quality.EMPTY: 1.0}
    known, out = quality.Words(), Counter()
    low = [known[w] & ((1 << quality.SHAPE_BITS) - 1) for w in words]
    shapes = [1 if i and known[w] == known[words[i - 1]] else s for i, (w, s) in enumerate(zip(words, low))]
    texts = [known[w] >> quality.SHAPE_BITS for w in words]
    for k, (n, of_shapes) in enumerate(quality.FAMILIES):
        row = shapes if of_shapes else texts
        grams = [row[i : i + n] for i in range(len(row) - n + 1)]
        for g in grams:
            h = 0x9E3779B97F4A7C15 + 7 * k
            for x in g:
                h = (h ^ x) * 0xFF51AFD7ED558CCD % 2**64
                h ^= h >> 32
            out[(h * 0x9FB21C651E98DF25 % 2**64) >> (64 - quality.BITS)] += 1 / len(grams)
    return out


def test_dot_products_equal_plain_counts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "One", "The the THE the the 12 $$$ a-b é", "x\x1cy z", "a " * 30_000]
    texts += [" ".join(rng.choice(["Der", "der", "der", "A!!", "|", "9.", "naïve", "中文"]) for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    want = [quality.SCALE * sum(v * float(weights[b]) for b, v in slow_features(t).items()) for t in texts]
    assert np.allclose(quality.dot(texts, quality.Words(), weights), want, atol=1e-4)


def test_words_are_forgotten_without_a_change(monkeypatch):
    texts = [" ".join(f"w{i % 40} W{i % 7}." for i in range(300)), "w1 w2 w3"]
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    want = quality.dot(texts, quality.Words(), weights)
    monkeypatch.setattr(quality, "MEMORY", 5)
    assert (quality.dot(texts, quality.Words(), weights) == want).all()


def test_awkward_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiouxyz") for _ in range(6))
    rows = [(i, " ".join(word() if i % 2 else "$$$" for _ in range(20)), "en", "s", 0.1, "k") for i in range(200)]
    more = [(500, None), (501, ""), (502, " "), (503, "x " * 50_000), (None, "$$$ $$$"), (7, rows[7][1]), (7, "$$$ $$$ $$$")]
    docs = spark.createDataFrame(rows + [(i, t, "en", "s", 0.1, "k") for i, t in more], DOC)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(9, None, "x"), (None, 1, "x"), (999, 1, "x"), (8, 1, "x")], "doc_id long, quality int, text string")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) + len(more) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 7)
    assert sorted(r.predicted for r in got if r.doc_id == 7) == [0, 1, 1]
    assert len({r.score for r in got if r.doc_id in (500, 501, 502)}) == 1
    assert [r.predicted for r in got if r.doc_id is None] == [0]
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in quality.score_quality(docs, labels.limit(0)).collect()} == {1}
    assert {r.predicted for r in quality.score_quality(docs, labels.where("quality = 0")).collect()} == {0}
