"""Exact near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class first. The classes' unit vectors are rotated onto the principal axes and packed into blocks
of neighbours along the first axis. Pairs of blocks are tiles. In a tile one product adds up the leading axes only and
bounds the rest by the product of the suffix norms (the norm is carried as one more coordinate, so the bound is a single
matrix product); pairs whose bound misses the threshold stop there. The survivors go on over more axes, and those left
get their cosine in double precision over the vectors as given. Tiles whose first-axis ranges lie further apart than two
unit vectors of that cosine can be are never built.

Blocks of neighbours form strips of up to STRIP blocks, and a task compares two whole strips, so a vector is shuffled once
for each strip it meets and not for each block. A strip pair returns counts and a spanning forest of its links, never the
links themselves, so a group of any size costs a row per vector and strip. The work is n * n / 2 bounded products; the
driver sees the d x d moments and the block borders. Blocks that many equal places on the first axis would swell are
split by a hash.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are components of their
own. Vectors of different lengths do not link. Repeated rows (equal vectors) link with one another; a component's name is
its smallest vec_id, so ties do not matter. Extra columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from metaloom.llm.shared import components, cut

BLOCK, THRESHOLD = 2048, 0.9
#: What single precision may lose in a bound; exact decisions are made in double precision.
SLACK = 1e-4
SUB = 1024
#: Blocks of a strip, at most, and bytes of vectors that one aims at.
STRIP, STRIP_BYTES = 8, 32 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column) -> np.ndarray:
    """A list column without nulls as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _moments(classes: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of the unit vectors, dim x dim; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_rows(batch.column(0)))
                total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = classes.select("embedding").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s"))
    out = np.zeros((dim, dim))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # dim * dim rows at most
        out[r.i, r.j] = r.s
    return out


def axes_of(moments: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Rotation with the strongest axis first, and after how many axes a bound is taken."""
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    order = np.argsort(values)[::-1]
    share = np.cumsum(np.maximum(values[order], 0)) / max(values.sum(), 1e-300)
    dim = len(values)
    stops = sorted({min(dim, int(np.searchsorted(share, s) + 1)) for s in (0.4, 0.7)})
    return vectors[:, order], [k for k in stops if k < dim]


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, axes: np.ndarray, stops: list[int], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of the pairs with cosine >= threshold, piece by piece; same: i < j only."""
    if same:
        y = x
    px, py = x @ axes, y @ axes

    def led(p: np.ndarray, k: int) -> np.ndarray:
        tail = np.sqrt(np.maximum((p[:, k:] ** 2).sum(1, keepdims=True), 0))
        return np.hstack([p[:, :k], tail]).astype(np.float32)

    first = stops[0] if stops else axes.shape[1]
    lx, ly = led(px, first), led(py, first)
    for a in range(0, len(x), SUB):
        for b in range(a if same else 0, len(y), SUB):
            i, j = np.nonzero(lx[a : a + SUB] @ ly[b : b + SUB].T >= threshold - SLACK)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65536):
                ii, jj = i[at : at + 65536], j[at : at + 65536]
                for k in stops[1:]:
                    head = np.einsum("ij,ij->i", px[ii, :k], py[jj, :k])
                    tail = np.linalg.norm(px[ii, k:], axis=1) * np.linalg.norm(py[jj, k:], axis=1)
                    ok = head + tail >= threshold - SLACK
                    ii, jj = ii[ok], jj[ok]
                ok = np.einsum("ij,ij->i", x[ii], y[jj]) >= threshold
                if ok.any():
                    yield ii[ok], jj[ok]


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest node that each of n nodes reaches."""
    label = np.arange(n)
    while pairs:
        before = label.copy()
        for i, j in pairs:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            np.minimum.at(label, before[i], low)
            np.minimum.at(label, before[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def _pack(classes: DataFrame, axis: np.ndarray, borders: list[float], kind: str) -> DataFrame:
    """One row per block: neighbours along the first axis with their ids, copies and vectors (of a numpy kind) as bytes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _unit(_rows(batch.column(0))) @ axis
                block = np.searchsorted(np.array(borders), at, side="right").astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(block)], ["embedding", "rep", "copies", "at", "block"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at, x = group["at"].to_numpy(), _rows(group["embedding"].combine_chunks())
        row = (group["block"][0].as_py(), group["part"][0].as_py(), float(at.min()), float(at.max()), group["rep"].to_numpy().astype("<i8").tobytes(), group["copies"].to_numpy().astype("<i8").tobytes(), x.astype(kind).tobytes())
        return pa.table([[c] for c in row], schema=pa.schema([("block", pa.int64()), ("part", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]))

    placed = cut(classes.select("embedding", "rep", "copies").mapInArrow(place, "embedding array<double>, rep long, copies long, at double, block long"), "placed")
    parts = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("parts"))
    spread = placed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    return spread.groupBy("block", "part").applyInArrow(pack, "block long, part long, lo double, hi double, ids binary, copies binary, vectors binary")


def _near_strips(strips: DataFrame, width: float) -> DataFrame:
    """Pairs of strips (a, b), a <= b, whose first-axis ranges come within width, found by equal cells of that axis."""
    cell = lambda c, by: F.floor(F.col(c) / F.lit(width)).cast("long") + F.lit(by)
    a = strips.select(F.col("strip").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell("lo", 0), cell("hi", 0))).alias("cell"))
    b = strips.select(F.col("strip").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("cell"))
    near = (F.col("a") <= F.col("b")) & (F.col("lo_b") - F.col("hi_a") <= width + SLACK) & (F.col("lo_a") - F.col("hi_b") <= width + SLACK)
    return a.join(b, "cell").where(near).select("a", "b").distinct()


def _compare(classes: DataFrame, dim: int, threshold: float, kind: str) -> DataFrame:
    """(x, y, n): for n >= 0 rep x has n links in a pair of strips; for n = -1 x and y are linked (a spanning forest)."""
    spark = classes.sparkSession
    axes, stops = axes_of(_moments(classes, dim))
    n = classes.count()
    cuts = [k / (-(-n // BLOCK)) for k in range(1, -(-n // BLOCK))]
    axis = axes[:, 0]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_unit(_rows(batch.column(0))) @ axis)], ["at"])

    borders = classes.select("embedding").mapInArrow(along, "at double").approxQuantile("at", cuts, 1 / max(1000, 4 * len(cuts))) if cuts else []
    each = max(1, min(STRIP, len(cuts) // 8, STRIP_BYTES // (BLOCK * dim * np.dtype(kind).itemsize)))
    strip = F.floor(F.col("block") / each) * (1 << 24) + F.floor(F.col("part") / each)
    blocks = cut(_pack(classes, axis, borders, kind).withColumn("strip", strip.cast("long")), "blocks")
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pairs = cut(_near_strips(blocks.groupBy("strip").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), width), "pairs")
    at = lambda s, where: pairs.where(where).join(blocks, F.col(s) == F.col("strip")).select("a", "b", F.lit(s).alias("side"), "block", "part", "lo", "hi", "ids", "copies", "vectors")
    met = at("a", "true").union(at("b", "a < b"))
    shipped = spark.sparkContext.broadcast((axes, stops))  # dim * dim numbers

    def run(group: pa.Table) -> pa.Table:
        axes, stops = shipped.value
        group = group.sort_by([("side", "ascending"), ("block", "ascending"), ("part", "ascending")])
        ids, copies, unit, span, side = [], [], [], [], group["side"].to_pylist()
        for r in range(group.num_rows):
            ids.append(np.frombuffer(group["ids"][r].as_buffer(), "<i8"))
            copies.append(np.frombuffer(group["copies"][r].as_buffer(), "<i8"))
            unit.append(_unit(np.frombuffer(group["vectors"][r].as_buffer(), kind).reshape(len(ids[-1]), dim)))
            span.append((group["lo"][r].as_py(), group["hi"][r].as_py()))
        first = np.cumsum([0, *map(len, ids)])
        ids, copies = np.concatenate(ids), np.concatenate(copies)
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        two = "b" in side
        for p in range(len(unit)):
            for q in range(p, len(unit)):
                if two and side[p] == side[q] or span[q][0] - span[p][1] > width + SLACK or span[p][0] - span[q][1] > width + SLACK:
                    continue
                for i, j in tile_links(unit[p], unit[q], p == q, axes, stops, threshold):
                    i, j = i + first[p], j + first[q]
                    counts += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                    chain = np.nonzero(label != np.arange(len(ids)))[0]
                    label = _forest(len(ids), [(i, j), (chain, label[chain])])
        linked, moved = np.nonzero(counts)[0], np.nonzero(label != np.arange(len(ids)))[0]
        x = np.concatenate((ids[linked], ids[moved]))
        y = np.concatenate((ids[linked], ids[label[moved]]))
        k = np.concatenate((counts[linked], np.full(len(moved), -1)))
        return pa.table([pa.array(x), pa.array(y), pa.array(k)], ["x", "y", "n"])

    return cut(met.groupBy("a", "b").applyInArrow(run, "x long, y long, n long"), "tiles")


def vector_components(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of embeddings (vec_id, embedding)."""
    given = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = given.where(F.coalesce(usable, F.lit(False)))
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    dims = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]  # lengths of vectors, a handful
    element = getattr(embeddings.schema["embedding"].dataType, "elementType", None)
    kind = "<f4" if isinstance(element, FloatType) else "<f8"
    found = None
    for dim in sorted(dims):
        part = _compare(classes.where(F.size("embedding") == dim), dim, threshold, kind)
        found = part if found is None else found.union(part)
    if found is None:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.where("n >= 0").groupBy("x").agg(F.sum("n").alias("n"))
    comp = components(found.where("n = -1").select(F.col("x").alias("u"), F.col("y").alias("v")))
    home = classes.join(links, classes["rep"] == links["x"], "left").join(comp, classes["rep"] == comp["node"], "left")
    home = home.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = good.join(home, "embedding").select("vec_id", "n_links", "component_id")
    alone = given.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
