"""Document quality: hashed word n-grams into a logistic regression trained by follow-the-regularised-leader updates.

A word is what stands between white space. It counts by its text (lower-cased) and by its shape, which writes letters as A
or a, digits as 0 and keeps marks, runs cut to two; a word equal to the one before has the shape '='. Features are n-grams
of texts (1, 2) and of shapes (1 to 3), hashed into 2**BITS buckets; each family's values sum to one, so that length does
not matter. A score is the logistic function of the sparse dot product of a document's features with the weights.

Training is bounded: SAMPLE labelled documents of each class, by the smallest hashes of their doc_ids among the rows whose
crc32 remainder allows it, and SAMPLE_CHARS characters of each class; texts of more than a fiftieth of that are not trained
on, but scored whole like any other. The bias is moved from the sample's share of good documents to that of all labels.
Labels, lang, source and doc_id are never inputs of a score.

Texts without a word (null, empty, white space only) have one feature of their own. Null labels are ignored; a document
with several labels is good only if all say so; of several texts with one doc_id training takes that with the smallest
hash. With labels of one class only every score is that class, without any 1. Repeated rows score alike, equal scores stay
equal. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE, memo

BITS = 20
SAMPLE, SAMPLE_CHARS = 3000, 6_000_000
ROUNDS, ALPHA, BETA, L1, L2 = 4, 2.0, 0.02, 2e-4, 1e-4
SCALE = 8.0
CUT_OFF = 0.3
#: Words that a worker remembers.
MEMORY = 300_000
#: Low bits of a word's number: its shape.
SHAPE_BITS = 20
SAME = np.uint64(1)
#: (length, of shapes) of each family of n-grams.
FAMILIES = ((1, False), (2, False), (1, True), (2, True), (3, True))
#: Bucket of texts without a word.
EMPTY = 0


class _Shapes(dict):
    """Code point -> the character that stands for it in a shape."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = unicodedata.category(c)
        self[point] = out = "A" if kind in ("Lu", "Lt") else "a" if kind[0] in "LM" else "0" if kind[0] == "N" else c if point < 128 else kind
        return out


_CHARS = _Shapes()
_LONG = re.compile(r"(.)\1\1+", re.S)


class Words(dict):
    """Word -> hash of its text in the high bits, of its shape in the low ones; forgets all beyond MEMORY words."""

    def __missing__(self, word: str) -> int:
        shape = _LONG.sub(r"\1\1", word.translate(_CHARS))
        text = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        low = xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass")) & ((1 << SHAPE_BITS) - 1)
        out = (text >> SHAPE_BITS << SHAPE_BITS) | max(low, 2)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out
        return out


def features(texts: list[str | None], known: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each family: (buckets, row of each bucket, n-grams of each row), n-grams in order and repeats included."""
    cut = [(t or "").split() for t in texts]
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    both = np.fromiter((known[w] for words in cut for w in words), np.uint64, int(size.sum()))
    row = np.repeat(np.arange(len(cut)), size)
    shape = both & np.uint64((1 << SHAPE_BITS) - 1)
    again = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
    shape[1:][again] = SAME
    text = both >> np.uint64(SHAPE_BITS)
    found = []
    for k, (n, shapes) in enumerate(FAMILIES):
        from_ = shape if shapes else text
        m = max(len(from_) - n + 1, 0)
        h = np.full(m, 0x9E3779B97F4A7C15 + 7 * k, np.uint64)
        for d in range(n):
            h = (h ^ from_[d : d + m]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        whole = row[:m] == row[n - 1 :][:m]
        h = h[whole] if n > 1 else h
        owner = row[:m][whole] if n > 1 else row
        found.append(((h * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - BITS)).astype(np.int64), owner, np.maximum(size - n + 1, 0)))
    none = np.nonzero(size == 0)[0]
    found.append((np.full(len(none), EMPTY), none, (size == 0).astype(np.int64)))
    return found


def dot(texts: list[str | None], known: Words, weights: np.ndarray) -> np.ndarray:
    """The dot product of each text's features with the weights."""
    out = np.zeros(len(texts))
    for bucket, row, n in features(texts, known):
        out += np.bincount(row, weights[bucket], len(texts)) / np.maximum(n, 1)
    return out * SCALE


def train(texts: list[str | None], good: np.ndarray, prior: float, seed: int = 11) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal updates, a document at a time, in ROUNDS shuffled passes."""
    known, rows = Words(), []
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        owner, bucket, value = [], [], []
        for b, r, n in features(part, known):
            owner.append(r)
            bucket.append(b)
            value.append(SCALE / n[r])
        owner, bucket, value = map(np.concatenate, (owner, bucket, value))
        key, inverse = np.unique(owner << BITS | bucket, return_inverse=True)
        value = np.bincount(inverse, value, len(key))
        ends = np.searchsorted(key, np.arange(len(part) + 1) << BITS)
        rows += [((key[a:b] & ((1 << BITS) - 1)).astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(ends, ends[1:])]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w, c = weight(z[at], n[at]), -bias_z / ((1 + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + c, -35, 35)))
            e = p - good[i]
            g = e * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            sigma = ((bias_n + e * e) ** 0.5 - bias_n**0.5) / ALPHA
            bias_z += e - sigma * c
            bias_n += e * e
    share = min(max(good.mean(), 1e-6), 1 - 1e-6)
    bias = -bias_z / ((1 + bias_n**0.5) / ALPHA) + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return weight(z, n).astype(np.float32), float(bias)


def remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Trains on a bounded sample of the labelled rows with a crc32 remainder other than 0."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = texts.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    here = known.join(sizes, "doc_id")
    share = {r.good: r["count"] for r in here.groupBy((F.col("quality") > 0).alias("good")).count().collect()}  # two rows
    if not share.get(True) or not share.get(False):
        return np.zeros(1 << BITS, np.float32), -35.0 if share.get(False) else 35.0
    picks = []
    for good in (False, True):
        order = (F.xxhash64("doc_id"), F.col("doc_id"))
        first = here.where(((F.col("quality") > 0) == good) & (F.col("size") <= SAMPLE_CHARS // 50)).orderBy(*order).limit(sample)
        so_far = F.sum("size").over(Window.orderBy(*order))  # over sample rows
        picks.append(first.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).select("doc_id", F.lit(good).alias("good")))
    found = texts.join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    rows = found.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()  # 2 * sample rows, 2 * SAMPLE_CHARS characters
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([r.text for r in rows], np.array([r.good for r in rows]), share[True] / (share[True] + share[False]))


def score_quality(docs: DataFrame, labels: DataFrame, cut_off: float = CUT_OFF) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels))  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value
        known = memo("quality").setdefault("words", Words())
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                z = dot(part.column("text").to_pylist(), known, weights) + bias
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))
