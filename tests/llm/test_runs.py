"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from metaloom.llm import periodic_runs

DOC = "doc_id long, text string, lang string, runs string, start long, n_words string"


def slow_runs(x, shortest=24, times=3):
    n, out = len(x), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            w = x[i : j + q]
            if len(w) >= max(shortest, times * q) and not any(w[r:] == w[: len(w) - r] for r in range(1, q)):
                out.add((i, len(w), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    x = []
    while len(x) < n:
        x += [rng.randrange(letters) for _ in range(rng.randrange(1, 9))] * (rng.randrange(1, 12) if rng.random() < 0.5 else 1)
    return x[:n]


@pytest.mark.parametrize("step", [5, 60, periodic_runs.STEP])
def test_runs_equal_brute_force(step, monkeypatch):
    monkeypatch.setattr(periodic_runs, "STEP", step)
    rng = random.Random(step)
    for _ in range(250):
        x = periodic(rng, rng.randrange(140), rng.choice([1, 2, 3, 8]))
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(x, np.int32)).tolist()] == slow_runs(x)


def test_extensions_equal_brute_force():
    rng = random.Random(2)
    for n in (2, 17, 200):
        x = np.array(periodic(rng, n, 2), np.int32)
        i, k = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        i, k = i[i != k], k[i != k]
        got = periodic_runs.Extensions(x).at(i, k)
        for a, b, g in zip(i.tolist(), k.tolist(), got.tolist()):
            want = 0
            while max(a, b) + want < n and x[a + want] == x[b + want]:
                want += 1
            assert g == want


def report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words and doc_id is not None:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_report_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "a\x1cb " * 30, "é é " * 40, ("x y z " * 9 + "q ") * 5, "b " * 30 + "c " * 90]
    texts += [" ".join(f"w{k}" for k in periodic(rng, rng.randrange(160), rng.choice([2, 3, 30, 300]))) for _ in range(120)]
    rows = [(i, t, "en", "clash", 5, "clash") for i, t in enumerate(texts)] + [(None, "a " * 40, "en", "", 1, ""), (3, "one", "en", "", 1, ""), (3, "one", "en", "", 1, "")]
    got = periodic_runs.run_report(spark.createDataFrame(rows, DOC))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == ["doc_id", *names]
    found = sorted([tuple(r) for r in got.collect()], key=repr)
    assert found == sorted([(r[0], *report(r[0], r[1])) for r in rows], key=repr)
    assert periodic_runs.run_report(spark.createDataFrame([], DOC)).count() == 0


def test_a_very_long_text_is_quick(spark):
    text = "again and again " * 60_000 + "end"
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 180_000, 3)] and row.collapsed == "again and again end"
