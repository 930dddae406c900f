"""Benchmark decontamination by SimHash windows.

A window is as many words as a benchmark item has. Windows and items are lower-cased (A-Z) word sequences cut at white
space; their features are five-word shingles with repeats. A document is contaminated by an item if one of its windows
has weighted Jaccard similarity (sum of minima over sum of maxima of shingle counts) of THRESHOLD or more.

1. Windows: only those that share a shingle with some item can be similar at all, so a window is looked at only where
   that can be: every placement that covers a shingle of the item. This loses nothing and keeps clean text cheap.
2. A window's 64-bit SimHash is looked up in the multi-index of the items of its size: RADIUS + 1 blocks of bits, so any
   fingerprint within the radius agrees with the item's on a whole block. A similarity of 0.8 differs in 10 bits on
   average with a standard deviation of 3; the radius of 24 lies almost five deviations above. At such a radius blocks
   have two or three bits and do not select alone; what selects is that a window meets only items of its own size that
   also own one of its shingles.
3. Each candidate is verified by its exact weighted shingle similarity.

The benchmark is read in slices of at most SLICE_ITEMS items, and a broadcast holds one slice, whatever the benchmark's
size; documents are scanned once for each slice. Items and texts shorter than five words are one shingle.

Null and empty texts match nothing; null and empty items are ignored. Repeated items or rows match alike. Extra columns
are ignored. An empty benchmark finds nothing, an empty table of documents gives an empty result. Very long texts are
scanned whole, in memory in proportion to their words. A similarity of just THRESHOLD counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE, majority_bits, shingle_hashes, words_of

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 24
SLICE_ITEMS = 20_000
_NONE: frozenset[int] = frozenset()


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks over 64 bits."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Index:
    """Items of one slice: their shingles, sizes in words, fingerprints and, for each size, the multi-index over them."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, radius: int = RADIUS) -> None:
        self.width, self.radius, self.blocks = width, radius, _blocks(radius)
        self.ids, self.words, self.counts, self.prints = [], [], [], []
        self.owners: dict[int, dict[int, list[int]]] = {}
        self.table: dict[tuple[int, int, int], set[int]] = {}
        self.looked_up = 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            k, size = len(self.ids), len(words)
            hashes = shingle_hashes(words, width)
            self.ids.append(item)
            self.words.append(size)
            self.counts.append(dict(zip(*(x.tolist() for x in np.unique(hashes, return_counts=True)))))
            self.prints.append(majority_bits(hashes))
            for h in self.counts[-1]:
                self.owners.setdefault(h, {}).setdefault(size, []).append(k)
            for no, (o, n) in enumerate(self.blocks):
                self.table.setdefault((size, no, self.prints[-1] >> o & ((1 << n) - 1)), set()).add(k)
        self.known = np.array(sorted(self.owners), np.uint64)

    def near(self, fingerprint: int, size: int, among: set[int]) -> set[int]:
        """Of items of a size, those whose fingerprints differ in radius bits at most."""
        found: set[int] = set()
        for no, (o, n) in enumerate(self.blocks):
            found |= self.table.get((size, no, fingerprint >> o & ((1 << n) - 1)), _NONE) & among
            if len(found) == len(among):
                break
        self.looked_up += len(found)
        return {k for k in found if (self.prints[k] ^ fingerprint).bit_count() <= self.radius}

    def similarity(self, k: int, hashes: np.ndarray) -> float:
        mine, total = self.counts[k], 0
        for h, n in zip(*(x.tolist() for x in np.unique(hashes, return_counts=True))):
            total += min(n, mine.get(h, 0))
        return total / (sum(mine.values()) + len(hashes) - total)

    def matches(self, text: str | None, threshold: float = THRESHOLD) -> dict[int, float]:
        """item -> best similarity of a window, for items with a window at the threshold or above."""
        if not len(self.known):
            return {}
        hashes = shingle_hashes(words_of(text), self.width)
        if not len(hashes):
            return {}
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hits = np.nonzero(self.known[at] == hashes)[0].tolist()
        sizes = {size for p in hits for size in self.owners[int(hashes[p])]}
        best: dict[int, float] = {}
        for size in sizes:
            span = max(1, size - self.width + 1)
            last = max(0, len(hashes) - span)
            mine = [p for p in hits if size in self.owners[int(hashes[p])]]
            edge = np.unique(np.concatenate([np.arange(max(0, min(p - span + 1, last)), min(p, last) + 1) for p in mine]))
            for lo in range(0, len(edge), 4096):
                part = edge[lo : lo + 4096]
                first = int(part[0])
                reach = hashes[first : int(part[-1]) + span]
                bits = np.unpackbits(reach.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
                a = part - first
                b = np.minimum(a + span, len(reach))
                prints = np.packbits(2 * (sums[b] - sums[a]) > (b - a)[:, None], axis=1)
                for s, e, raw in zip(a.tolist(), b.tolist(), prints):
                    window = reach[s:e]
                    among = {k for p in mine[bisect_left(mine, first + s) : bisect_left(mine, first + e)] for k in self.owners[int(hashes[p])][size]}
                    for k in self.near(int.from_bytes(raw.tobytes(), "big"), size, among):
                        x = self.similarity(k, window)
                        if x >= threshold and x > best.get(k, 0):
                            best[k] = x
        out: dict[int, float] = {}
        for k, x in best.items():
            out[self.ids[k]] = max(x, out.get(self.ids[k], 0))
        return out


def slices(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The benchmark's items with a text, in parts of about SLICE_ITEMS."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    parts = max(1, -(-items.count() // SLICE_ITEMS))
    for k in range(parts):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items


def shipped_index(part: DataFrame):
    """A broadcast of the index over one slice."""
    return part.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.collect()]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity: each item of which a document has a window at the threshold or above."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for part in slices(benchmark):
        shipped = shipped_index(part)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    out = [(d, item, x) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for item, x in sorted(index.matches(t, threshold).items())]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "similarity"])

        hits = rows.mapInArrow(run, "doc_id long, item_id long, similarity double")
        found = hits if found is None else found.union(hits)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without a window like any item, with all their columns."""
    for part in slices(benchmark):
        shipped = shipped_index(part)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    yield part.filter(pa.array([not index.matches(t, threshold) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, items (ids, ascending), similarity (the highest; 0 if none), kept: a row per document."""
    hits = contaminated(docs, benchmark).dropDuplicates(["doc_id", "item_id"])
    per = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    rows = docs.select(F.col("doc_id").cast("long"))
    return rows.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("n_items").isNull().alias("kept"))
