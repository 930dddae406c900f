"""Helpers that the training-data operators share: tables, cut lineage, words, connected components."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a Python operator takes from an Arrow batch, so that a batch of long texts is never held twice.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the folder may be in a store that only Spark opens)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master
    is local, too (tests). Elsewhere tables in a local folder would miss rows, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/metaloom-shared"
    return base.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: The folder that workspace() has opened.
_OPEN: ContextVar[str | None] = ContextVar("metaloom_workspace", default=None)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """The tables that cut() writes meanwhile go at the end, but for those that are to stay."""
    folder = new_dir(spark, "work")
    before = _OPEN.set(folder)
    try:
        yield
    finally:
        _OPEN.reset(before)
        _delete(spark, folder)


def cut(df: DataFrame, what: str = "step", stays: bool = False) -> DataFrame:
    """df as a table written in the shared folder: the lineage ends there and lost executors lose nothing."""
    spark, folder = df.sparkSession, _OPEN.get()
    path = f"{folder}/{what}-{uuid.uuid4().hex}" if folder and not stays else new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes what cut() wrote, once no later step reads it."""
    base = shared_dir(df.sparkSession)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base.split("://")[-1].lstrip("/") in name:
            _delete(df.sparkSession, name)


def release(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files once the driver's collector finds its plan unused, which may be long after a step. Run
    between steps that shuffle much, so that their disk does not add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows in an Arrow batch where they carry whole texts. With Spark's 10,000 a batch holds a task's texts at once, twice while
#: its buffer grows, outside the heap and again in the Python worker; buffers of this size come from Arrow's pool.
TEXT_ROWS = 256
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """While it lasts, Arrow batches hold few rows: rows that carry whole texts or shingle sets may have megabytes each."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: Rows of long integers that few() sends to every executor at most: some 30 MB there.
SENT_ROWS = 1_000_000


def few(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df joined with ids on ids' only column, for a left_semi or left_anti join: by broadcast if a count shows that ids
    has SENT_ROWS rows at most, by a shuffle otherwise."""
    ids = cut(ids, "ids", stays=True)
    return df.join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, ids.columns[0], how)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and U+0009 to U+000D only; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words joined by a space, repeats included; fewer words: one shingle; none: no row."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    k = n - width + 1
    return np.fromiter((digest(buf[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[width - 1 :].tolist())), np.uint64, k)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes; no hash gives 0."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def memo(name: str) -> dict:
    """What this Python worker remembers under a name from task to task. Workers serve one operator after another, so
    what was remembered under other names goes."""
    kept = sys.modules.setdefault("_metaloom_memo", types.ModuleType("_metaloom_memo")).__dict__
    for other in [k for k, v in kept.items() if isinstance(v, dict) and k != name and not k.startswith("__")]:
        del kept[other]
    return kept.setdefault(name, {})


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(batches):
    """Of a partition's edges, one (node, smallest node it reaches within the partition) per node."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"u": part, "v": [find(x) for x in part]}, dtype="int64")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) reaches.

    Each partition first keeps a spanning forest of its edges. Then large-star and small-star steps alternate over all
    edges until they change nothing; every round is a written table. Aggregation is partial before each shuffle, so a
    node with very many edges costs a row per task. Neither edges nor labels reach the driver, only counts.
    Nulls: edges with a null end are dropped. Loops and repeated edges are harmless. Empty input: empty output.
    """
    tidy = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = cut(tidy.mapInPandas(_forest, "u long, v long"), "edges")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = lower.select("u", F.col("m").alias("v")).union(moved).where("u <> v").distinct()
        after = cut(small, "small")
        drop_table(large)
        drop_table(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    root = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root.select("v", "v"))
