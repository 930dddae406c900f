"""URL filter: host and path rules, then a ratio of two character language models.

The urls that a rule decides are the labelled corpus. Two Markov models over characters, one of allowed and one of
blocked urls, are counted over all of them. A model interpolates contexts of three characters down to none
(Witten-Bell), so a context that was never seen leaves its shorter one in charge. A url's score is the mean over its
characters of log P(allowed) - log P(blocked). The threshold is calibrated on urls of held-out hosts, scored by models
that never saw those hosts: the one with the best balanced accuracy.

Counts cover every row; tasks sum them before the shuffle. The model is a table of ALPHABET**ORDER numbers at most
(2.56 million, 10 MB), whatever the input's size, so it may be sent to every executor.

Nulls and urls without '://' have an empty host and path and no rule; the method judges the url's characters (none for
null: only its end mark). Repeated rows count each time. Extra columns are ignored. Without labelled urls of both
verdicts every score is 0 or one-sided, and the threshold is 0. A score that equals the threshold allows. Very long urls are
scored whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 4
#: Characters that keep a code of their own; digits share one, the rest share another; then the start and end marks.
KEPT = "abcdefghijklmnopqrstuvwxyz/.-_?=&#%:"
DIGIT, OTHER, START, END = len(KEPT), len(KEPT) + 1, len(KEPT) + 2, len(KEPT) + 3
ALPHABET = END + 1
FOLDS = 5
BINS, SPAN = 4001, 8.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _ruled(host: Column, path: Column, value: int, rules=RULES) -> Column:
    """Of the longest rule that fits: its text (value 0) or its verdict (1); null if none fits."""
    out = F
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = out.when(fits, F.lit((h + p, verdict)[value]))
    return out


def _codes() -> np.ndarray:
    table = np.full(256, OTHER, np.int32)
    for i, c in enumerate(KEPT):
        table[ord(c)] = i
    for c in UPPER:
        table[ord(c)] = KEPT.index(c.lower())
    for c in "0123456789":
        table[ord(c)] = DIGIT
    return table


def _grams(urls: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram number at each character of each url, its end mark included, and where each url begins."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    pad = ORDER - 1
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + pad + 1
    codes = np.empty(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    body = np.ones(len(codes), bool)
    for k in range(pad):
        codes[starts + k] = START
        body[starts + k] = False
    inside = body.copy()
    inside[ends - 1] = False
    codes[inside] = table[np.frombuffer(b"".join(raw), np.uint8)]
    codes[ends - 1] = END
    gram = np.zeros(len(codes), np.int64)
    for k in range(pad, -1, -1):
        gram = gram * ALPHABET + np.concatenate((np.zeros(k, np.int64), codes[: len(codes) - k]))
    return gram[body], starts - pad * np.arange(len(raw))


def _counts(labelled: DataFrame) -> DataFrame:
    """(blocked, fold, gram, n) over all rows of (url, blocked, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codes()
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            urls = np.array(batch.column("url").to_pylist(), object)
            kind = batch.column("blocked").to_numpy(zero_copy_only=False) * 2 + batch.column("held").to_numpy(zero_copy_only=False)
            for k in np.unique(kind):
                grams, _ = _grams(urls[kind == k].tolist(), table)
                key, n = np.unique(grams, return_counts=True)
                sums.setdefault(int(k), np.zeros(ALPHABET**ORDER, np.int64))[key] += n
        for k, total in sums.items():
            key = np.nonzero(total)[0]
            for i in range(0, len(key), 50_000):
                part = key[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k // 2, np.int32)), pa.array(np.full(len(part), k % 2, np.int32)), pa.array(part), pa.array(total[part])], ["blocked", "held", "gram", "n"])

    rows = labelled.select("url", "blocked", "held").mapInArrow(run, "blocked int, held int, gram long, n long")
    return rows.groupBy("blocked", "held", "gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(last character | those before) for each ORDER-gram number, interpolated over all shorter contexts."""
    a = ALPHABET
    prob = np.full(a, 1.0 / a)
    for k in range(1, ORDER + 1):
        n = counts.reshape(-1, a**k).sum(0).reshape(-1, a).astype(np.float64)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        shorter = np.broadcast_to(prob.reshape(-1, a), (a, *prob.reshape(-1, a).shape)).reshape(-1, a) if k > 1 else prob[None, :]
        prob = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter).ravel()
    return np.log(prob)


def _scores(urls: list[str | None], ratio: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not urls:
        return np.zeros(0)
    grams, starts = _grams(urls, table)
    sums = np.add.reduceat(ratio[grams].astype(np.float64), starts)
    return sums / np.diff(np.append(starts, len(grams)))


def _ratio(rows, folds: tuple[int, ...]) -> np.ndarray:
    tables = [np.zeros(ALPHABET**ORDER, np.int64) for _ in range(2)]
    for blocked, held, gram, n in rows:
        use = np.isin(held, folds)
        for k in range(2):
            np.add.at(tables[k], gram[use & (blocked == k)], n[use & (blocked == k)])
    return (log_probabilities(tables[0]) - log_probabilities(tables[1])).astype(np.float32)


def _histogram(labelled: DataFrame, ratio) -> np.ndarray:
    """Held-out rows by verdict and score bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _codes(), np.zeros((2, BINS), np.int64)
        for batch in batches:
            at = np.clip(((_scores(batch.column("url").to_pylist(), ratio.value, table) / SPAN + 0.5) * BINS).astype(int), 0, BINS - 1)
            np.add.at(total, (batch.column("blocked").to_numpy(zero_copy_only=False), at), 1)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind, at])], ["blocked", "bin", "n"])

    rows = labelled.where("held = 1").select("url", "blocked").mapInArrow(run, "blocked int, bin int, n long").groupBy("blocked", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BINS))
    for r in rows.collect():  # 2 * BINS rows at most
        out[r.blocked, r.bin] = r.n
    return out


def threshold(histogram: np.ndarray) -> float:
    """Lower edge of the allowed bins with the best balanced accuracy (the middle one of equals); 0 without both verdicts."""
    if not histogram.sum(1).all():
        return 0.0
    share = histogram / histogram.sum(1, keepdims=True)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(share, axis=1)), axis=1)
    gain = below[1] - below[0]
    best = np.nonzero(gain >= gain.max() - 1e-12)[0]
    return float((best[len(best) // 2] / BINS - 0.5) * SPAN)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: a row per row of pages."""
    spark = pages.sparkSession
    parts = with_host_path(pages.select("page_id", "url"))
    host, path = F.col("host"), F.col("path")
    ruled = parts.withColumns({"rule": _ruled(host, path, 0, rules), "ruled": _ruled(host, path, 1, rules)})
    labelled = ruled.where(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "block").cast("int").alias("blocked"), (F.pmod(F.crc32("host"), F.lit(FOLDS)) == 0).cast("int").alias("held"))
    found = _counts(labelled).toArrow()  # 4 * ALPHABET**ORDER rows at most
    rows = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("blocked", "held", "gram", "n")) for b in found.to_batches()]
    trial = spark.sparkContext.broadcast(_ratio(rows, (0,)))
    least = threshold(_histogram(labelled, trial))
    ratio = spark.sparkContext.broadcast(_ratio(rows, (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codes()
        for batch in batches:
            score = _scores(batch.column("url").to_pylist(), ratio.value, table)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(score)], ["page_id", "host", "path", "rule", "ruled", "score"])

    scored = ruled.select("page_id", "host", "path", "rule", "ruled", "url").mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
