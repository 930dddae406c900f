"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed n-grams of 3 to 6 characters, word edges included, so an unseen misspelling shares most vectors with the word it
hides. A window of WINDOW words averages its n-grams' vectors and goes through a linear softmax of two classes; a
document's logit is that of its most toxic window, over the whole text, so length does not dilute a few words. Vectors
and softmax are trained together. A document's label says nothing about which window earns it: the first round picks
the window with the highest word log odds, later rounds the window that the model itself scores highest (for clean
documents these are the hard negatives), beside random ones. Random misspellings of words and left-out n-grams in
training keep the model from leaning on whole words. The logit is calibrated on training documents held back from the
fit, weighted to the share of toxic labels.

Training is bounded: SAMPLE labelled documents of each class, by the smallest hashes of their doc_ids among the rows
whose crc32 remainder allows it, and SAMPLE_CHARS characters of each class; texts of more than a fiftieth of that are not
trained on, but scored whole like any other. Labels, lang, source and doc_id are never inputs of a score.

Texts without a word (null, empty, only marks) score 0. Labels that are null are ignored; a document with several
labels counts as toxic if any says so; of several texts with one doc_id training takes that with the smallest hash.
Without labels of both classes every score is 0. Repeated rows score alike, equal scores stay equal. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE, memo

SAMPLE, SAMPLE_CHARS, HELD_BACK = 3000, 24_000_000, 0.2
BUCKETS, DIM, WINDOW = 1 << 17, 16, 3
GRAMS = (3, 4, 5, 6)
ROUNDS, BATCH, RATE = 12, 256, 0.15
CUT_OFF = 0.7
MEMORY = 300_000
EDGES = ".,;:!?|\"'()[]{}<>#$%&*-_=+/\\~`«»“”‘’…·"


def words_in(text: str | None) -> list[str]:
    """Lower-cased words between white space, without punctuation at their edges."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each word), words in a row."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(data))
    found, owners = [], []
    for n in GRAMS:
        fits = place + n <= ends
        at = place[fits]
        h = np.full(len(at), 0x9E3779B97F4A7C15 + n, np.uint64)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        found.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[fits])
    owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order] if found else np.empty(0, np.int64), np.bincount(owners, minlength=len(words))


def _misspelt(word: str, rng: np.random.Generator) -> str:
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    other = "abcdefghijklmnopqrstuvwxyz0134$@*"[int(rng.integers(33))]
    return (word[:i] + other + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + other + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :])[kind]


class Bags:
    """Words of a sample with their n-grams; word k's are gram[start[k]:start[k] + size[k]]."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in words_in(t)], np.int32) for t in texts]
        self.words = list(number)
        parts = [grams_of(self.words[i : i + 20_000]) for i in range(0, len(self.words), 20_000)]
        self.gram = np.concatenate([g.astype(np.int32) for g, _ in parts] or [np.empty(0, np.int32)])
        self.size = np.concatenate([n for _, n in parts] or [np.empty(0, np.int64)])
        self.start = np.cumsum(self.size) - self.size

    def take(self, words: np.ndarray, misspelt: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, which of the words each belongs to); those marked are misspelt anew."""
        plain = np.nonzero(~misspelt)[0]
        size = self.size[words[plain]]
        owner = np.repeat(np.arange(len(plain)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        found = self.gram[self.start[words[plain]][owner] + inside]
        other = np.nonzero(misspelt)[0]
        if not len(other):
            return found, plain[owner]
        gram, n = grams_of([_misspelt(self.words[w], rng) for w in words[other].tolist()])
        return np.concatenate((found, gram)), np.concatenate((plain[owner], np.repeat(other, n)))

    def word_sums(self, value: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' values for each word."""
        out = np.zeros(len(self.size))
        for i in range(0, len(self.size), 20_000):
            a, b = self.start[i], self.start[min(i + 20_000, len(self.size)) - 1] + self.size[min(i + 20_000, len(self.size)) - 1]
            total = np.concatenate((np.zeros(1), np.cumsum(value[self.gram[a:b]])))
            at = self.start[i : i + 20_000] - a
            out[i : i + 20_000] = total[at + self.size[i : i + 20_000]] - total[at]
        return out


def best_window(sums: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """(first word, mean) of the window with the highest mean over its n-grams; (0, 0.0) without n-grams."""
    n = len(sums)
    if not n:
        return 0, 0.0
    w = min(WINDOW, n)
    s, c = np.concatenate((np.zeros(1), np.cumsum(sums))), np.concatenate((np.zeros(1), np.cumsum(sizes)))
    mean = (s[w:] - s[:-w]) / np.maximum(c[w:] - c[:-w], 1)
    k = int(mean.argmax())
    return k, float(mean[k])


def train(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 5) -> dict:
    """The model: value (each n-gram's share of the logit), bias, and the calibration a, c."""
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    held = rng.random(len(texts)) < HELD_BACK
    fit = np.nonzero(~held)[0]
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    squares, soft_sq, bias_sq = np.full((BUCKETS, DIM), 1e-4, np.float32), np.full((2, DIM), 1e-2), np.full(2, 1e-2)

    seen = np.zeros((2, len(bags.words)))
    for i in fit:
        seen[int(toxic[i]), np.unique(bags.docs[i])] += 1
    group = np.maximum(np.array([(~toxic[fit]).sum(), toxic[fit].sum()]), 1)
    odds = np.log((seen[1] + 0.5) / (group[1] + 1)) - np.log((seen[0] + 0.5) / (group[0] + 1))

    for turn in range(ROUNDS):
        if turn == 0:
            sums, sizes = np.maximum(odds, 0) ** 2, np.ones(len(bags.words))
        else:
            sums, sizes = bags.word_sums(vectors @ (soft[1] - soft[0])), bags.size
        windows, labels = [], []
        for i in fit:
            doc = bags.docs[i]
            if not len(doc):
                continue
            k, _ = best_window(sums[doc], sizes[doc])
            windows.append(doc[k : k + WINDOW])
            labels.append(int(toxic[i]))
            if not toxic[i]:
                k = int(rng.integers(max(1, len(doc) - WINDOW + 1)))
                windows.append(doc[k : k + WINDOW])
                labels.append(0)
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            size = np.array([len(windows[b]) for b in batch])
            words = np.concatenate([windows[b] for b in batch])
            gram, owner = bags.take(words, rng.random(len(words)) < 0.25, rng)
            owner = np.repeat(np.arange(len(batch)), size)[owner]
            stay = rng.random(len(gram)) < 0.75
            gram, owner = gram[stay], owner[stay]
            count = np.maximum(np.bincount(owner, minlength=len(batch)), 1)
            used, inverse = np.unique(gram, return_inverse=True)
            share = 1.0 / count[owner]
            part = vectors[used]
            mean = np.stack([np.bincount(owner, share * part[inverse, d], len(batch)) for d in range(DIM)], axis=1)
            logit = mean @ soft.T + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            y = np.array([labels[b] for b in batch])
            delta = p
            delta[np.arange(len(batch)), y] -= 1
            delta /= len(batch)
            grads = np.bincount(inverse, share * delta[owner, 1], len(used))[:, None] * (soft[1] - soft[0])[None, :] * len(batch)
            squares[used] += grads**2
            vectors[used] -= RATE * grads / np.sqrt(squares[used])
            g = delta.T @ mean * len(batch) / 16
            soft_sq += g**2
            soft -= RATE * g / np.sqrt(soft_sq)
            g = delta.sum(0) * len(batch) / 16
            bias_sq += g**2
            bias -= RATE * g / np.sqrt(bias_sq)
    model = {"value": (vectors @ (soft[1] - soft[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}
    sums, sizes = bags.word_sums(model["value"].astype(np.float64)), bags.size
    check = np.nonzero(held)[0] if toxic[held].any() and not toxic[held].all() else np.arange(len(texts))
    z = np.array([best_window(sums[bags.docs[i]], sizes[bags.docs[i]])[1] for i in check]) + model["bias"]
    model["a"], model["c"] = calibrate(z, toxic[check], prior)
    return model


def calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """a, c of 1 / (1 + exp(-(a z + c))), by weighted logistic regression with the classes weighted to prior."""
    weight = np.where(y, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    goal = np.where(y, 1 - 0.5 / (y.sum() + 1), 0.5 / ((~y).sum() + 1))
    scale = max(z.std(), 1e-9)
    x = np.stack([(z - z.mean()) / scale, np.ones(len(z))], axis=1)
    t = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -35, 35)))
        g = x.T @ (weight * (goal - p)) - 1e-3 * t
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        t += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0] / scale), float(t[1] - t[0] * z.mean() / scale)


def remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Trains on a bounded sample of the labelled rows with crc32 remainder other than 1; None without both classes."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = texts.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    here = known.join(sizes, "doc_id")
    share = {r.toxic: r["count"] for r in here.groupBy("toxic").count().collect()}  # two rows
    if not share.get(0) or not share.get(1):
        return None
    picks = []
    for k in (0, 1):
        first = here.where((F.col("toxic") == k) & (F.col("size") <= SAMPLE_CHARS // 50)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over sample rows
        picks.append(first.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).select("doc_id", "toxic"))
    found = texts.join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()  # 2 * sample rows, 2 * SAMPLE_CHARS characters
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([r.text for r in rows], np.array([r.toxic == 1 for r in rows]), share[1] / (share[0] + share[1]))


def scorer(model: dict):
    """Scores of texts; remembers words."""
    value = model["value"].astype(np.float64)
    kept: dict[str, tuple[float, int]] = memo("toxicity")
    kept.clear()  # another model's, maybe

    def score(texts: list[str | None]) -> list[float]:
        out = []
        for text in texts:
            words = words_in(text)
            fresh = [w for w in dict.fromkeys(words) if w not in kept]
            if fresh:
                if len(kept) + len(fresh) > MEMORY:
                    kept.clear()
                    fresh = list(dict.fromkeys(words))
                gram, size = grams_of(fresh)
                total = np.concatenate((np.zeros(1), np.cumsum(value[gram])))
                end = np.cumsum(size)
                kept.update(zip(fresh, zip((total[end] - total[end - size]).tolist(), size.tolist())))
            both = np.array([kept[w] for w in words], np.float64).reshape(-1, 2)
            if not len(both):
                out.append(0.0)
                continue
            z = best_window(both[:, 0], both[:, 1])[1] + model["bias"]
            out.append(float(1 / (1 + np.exp(-np.clip(model["a"] * z + model["c"], -35, 35)))))
        return out

    return score


def score_documents(docs: DataFrame, labels: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the columns named in extra): a row per document."""
    model = fit_model(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    names = ["doc_id", *extra]
    rows = docs.select(F.col("doc_id").cast("long"), *[c for c in extra], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        score = scorer(model) if model else lambda texts: [0.0] * len(texts)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score(part.column("_text").to_pylist()), pa.float64())], [*names, "score"])

    schema = rows.select(*names).schema.add("score", "double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return rows.mapInArrow(run, schema).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT_OFF).cast("int").alias("predicted"), *extra)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = fit_model(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        score = scorer(model) if model else lambda texts: [0.0] * len(texts)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield part.filter(pa.array([x < CUT_OFF for x in score(part.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
