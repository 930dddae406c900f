"""Periodic runs of words: maximal repetitions by a harmonic grid of longest-common-extension queries.

A run of smallest period q is a stretch of at least max(SHORTEST, TIMES * q) words in which words q apart are equal and
which no neighbouring word extends. For each period p, the points 0, p, 2p, ... are laid over a text. A run of p holds
TIMES successive points at least, so asking for each j how far the text reads alike forward from jp and (j+1)p, and
backward from the words before them, finds each run with its exact ends. Both answers are range minima over the common
prefixes of neighbours in the suffix array of the text and of the reversed text. Points cost n/p for each p, n log n in
all. The queries are only put at points from which words p apart are equal at some places that a run has to hold, and
the arrays are only built for texts with such points. Stretches found for a multiple of their smallest period have the
same ends as those found for the smallest one, which is kept.

Words are what stands between spaces and U+0009 to U+000D; they are compared exactly, by numbers given within a text.
Null and empty texts have no words and no runs. Repeated rows give the same result each. Very long texts take memory in
proportion to their words (points go in parts). Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST, TIMES = 24, 3
#: Grid points looked at in one step.
STEP = 1 << 19
#: Rows that go back to Spark at a time.
ROWS = 64
BLOCK = 16
RUNS = "array<struct<start: long, length: long, period: long>>"


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix), by doubling the length that the places compare."""
    n, k = len(x), 1
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: max(n - k, 0)] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate((np.zeros(1, np.int64), np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32), rank.astype(np.int32)
        k *= 2


def common_prefixes(x: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place but the first, how far its suffix reads like that of the place before (the first: 0)."""
    text, before, n, h = x.tolist(), order.tolist(), len(x), 0
    out = [0] * n
    for i, r in enumerate(rank.tolist()):
        if not r:
            h = 0
            continue
        j = before[r - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        h -= h > 0
    return np.array(out, np.int32)


class Minima:
    """Range minima of an array: minima from both ends of each block, and a sparse table over blocks."""

    def __init__(self, a: np.ndarray) -> None:
        self.a = a
        padded = np.concatenate((a, np.full(-len(a) % BLOCK, np.iinfo(np.int32).max, np.int32))).reshape(-1, BLOCK)
        self.left = np.minimum.accumulate(padded, axis=1).ravel()
        self.right = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
        self.table = [padded.min(axis=1)]
        while 2 << len(self.table) - 1 <= len(self.table[0]):
            t, h = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-h], t[h:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each a[low..high], both ends included."""
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.right[low], self.left[high])
        for k, t in enumerate(self.table):
            between = last - first - 1
            at = np.nonzero((between >= 1 << k) & (between < 2 << k))[0]
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(t[first[at] + 1], t[last[at] - (1 << k)]))
        at = np.nonzero(first == last)[0]
        if len(at):
            out[at] = self.a[low[at]]
            for d in range(1, BLOCK):
                at = at[low[at] + d <= high[at]]
                out[at] = np.minimum(out[at], self.a[low[at] + d])
        return out


class Extensions:
    """How far a text reads alike from two different positions."""

    def __init__(self, x: np.ndarray) -> None:
        order, self.rank = suffix_array(x)
        self.minima = Minima(common_prefixes(x, order, self.rank))

    def at(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[k]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(jp, p), in parts of some STEP points, where a run of period p can lie.

    The first point i in a run of length L is p - 1 words behind its start at most, so that words p apart are equal from
    i to i + L - 2p; L is max(SHORTEST, TIMES * p) at least. Some of these pairs are looked at."""
    n, p = len(x), 1
    while max(SHORTEST, TIMES * p) <= n:
        periods = np.arange(p, min(n // TIMES, p + STEP) + 1)
        counts = np.maximum((n - 1 - np.maximum(SHORTEST, TIMES * periods) + periods) // periods, 0) + 1
        take = max(1, int(np.searchsorted(np.cumsum(counts), STEP)))
        counts, periods = counts[:take], periods[:take]
        period = np.repeat(periods, counts)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        i, period = (y[i + np.maximum(SHORTEST, TIMES * period) - period < n] for y in (i, period))
        for part in (0, 12, 6, 4, 8, 1, 10, 2):
            at = i + part * (np.maximum(SHORTEST, TIMES * period) - 2 * period) // 12
            keep = np.nonzero(x[at] == x[at + period])[0]
            i, period = i[keep], period[keep]
        yield i, period
        p += take


def runs_of(x: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in a sequence of numbers, by start, then period."""
    n, ahead, back = len(x), None, None
    found = np.empty((0, 3), np.int64)
    if n < SHORTEST:
        return found
    for i, p in grid(x):
        if not len(i):
            continue
        if ahead is None:
            ahead, back = Extensions(x), Extensions(np.ascontiguousarray(x[::-1]))
        forward = ahead.at(i, i + p)
        backward = np.zeros_like(forward)
        inner = np.nonzero(i)[0]
        backward[inner] = back.at(n - i[inner], n - i[inner] - p[inner])
        length = backward + p + forward
        keep = length >= np.maximum(SHORTEST, TIMES * p)
        found = np.concatenate((found, np.stack((i - backward, length, p), axis=1)[keep]))
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        same = (found[1:, :2] == found[:-1, :2]).all(axis=1)
        found = found[np.concatenate((np.ones(min(len(found), 1), bool), ~same))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text's words without what
    repeats, joined by a space): a row per document. change: gives the words to look at, from doc_id and words."""

    def one(doc_id: int | None, text: str | None) -> tuple[int, list[dict], str]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        words = change(doc_id, words) if change else words
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        if len(runs):
            keep = kept_words(len(words), runs)
            kept = [words[i] for i in np.nonzero(keep)[0].tolist()]
        else:
            kept = words
        return len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()], b" ".join(kept).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                rows = [one(d, t) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                arrays = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the stated change: where crc32 of doc_id ends in 0, words from some place on repeat a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_report(docs: DataFrame) -> DataFrame:
    """A row per document, changed by repeat_tail: doc_id, n_runs, the run of the greatest exponent, and digests."""
    best = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1))
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    found = periodic_runs(docs, repeat_tail).withColumn("best", F.get(best, F.lit(0)))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest.alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
