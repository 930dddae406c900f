"""An extraction cache in a shared folder, by content and by the extractor's version.

Each run that finds new contents writes a generation: `step-N/rows` (what was extracted, by key) and then `step-N/keys` (also
of contents that gave no rows). A generation counts once its keys are committed, so a run that is lost leaves nothing behind
that is read. compact() writes one `base-N` in place of all generations up to N; it drops other versions and the second of
two generations that hold the same key. A changed version reads everything again, an unchanged one only new contents.

A Bloom filter of fixed size stands before the exact look-up: keys that it does not know are new and skip the join with the
cache. Keys that it may know are looked up exactly, so a filter that is too small costs time but never a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.sources.scratch import cut
from metaloom.streaming.incremental import KEY_CHARS

#: Bits of the filter (2 MB, sent to each task) and hash functions; about ten bits a key leave 1 % to be looked up in vain.
BITS, HASHES = 1 << 24, 4
KEYS = "key string, extractor string"


def content_key(text: Column, version: str) -> Column:
    """The key of a content for an extractor's version; null is read as empty."""
    return F.substring(F.sha2(F.concat(F.lit(version + "\n"), F.coalesce(text, F.lit(""))), 256), 1, KEY_CHARS)


def generations(spark: SparkSession, folder: str) -> list[str]:
    """The committed generations to be read, in order: the last base and the steps after it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [n for n in names if re.fullmatch(r"(step|base)-\d{8}", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/keys/_SUCCESS"))]
    base = max((n for n in done if n.startswith("base")), default=None)
    since = int(base[5:]) if base else 0
    return [*([base] if base else []), *sorted(n for n in done if n.startswith("step") and int(n[5:]) > since)]


def _next(spark: SparkSession, folder: str) -> int:
    """A number above that of any generation, committed or not: a lost run's folder is not written again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return 1 + max((int(n[5:]) for n in names if re.fullmatch(r"(step|base)-\d{8}", n)), default=0)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(key, extractor, generation): each key once, of the first generation that has it."""
    parts = [spark.read.schema(KEYS).parquet(f"{folder}/{g}/keys").withColumn("generation", F.lit(g)) for g in generations(spark, folder)]
    if not parts:
        return spark.createDataFrame([], f"{KEYS}, generation string")
    each = reduce(DataFrame.unionByName, parts)
    return each.groupBy("key", "extractor").agg(F.min("generation").alias("generation"))  # base sorts before step


def rows(spark: SparkSession, folder: str, version: str, schema: str) -> DataFrame:
    """What is cached for a version: key and the extracted columns."""
    kept = entries(spark, folder).where(F.col("extractor") == version).select("key", "generation")
    parts = [spark.read.schema(f"key string, {schema}").parquet(f"{folder}/{g}/rows").withColumn("generation", F.lit(g)) for g in generations(spark, folder)]
    if not parts:
        return spark.createDataFrame([], f"key string, {schema}")
    return reduce(DataFrame.unionByName, parts).join(kept, ["key", "generation"], "left_semi").drop("generation")


def _places(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("key", F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def filter_words(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The Bloom filter of keys as 32-bit words; at most bits / 32 rows come to the driver, whatever the number of keys."""
    at = keys.select(F.explode(F.array(*_places(bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("set"))
    out = np.zeros(bits // 32, dtype=np.uint32)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().astype(np.uint32)
    return out


def may_know(keys: DataFrame, words: np.ndarray) -> DataFrame:
    """(key, may): whether the filter may know the key; false is certain."""
    bits = len(words) * 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = np.ones(batch.num_rows, dtype=bool)
            for i in range(HASHES):
                at = batch.column(1 + i).to_numpy()
                may &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(may)], ["key", "may"])

    return keys.select("key", *[p.alias(f"p{i}") for i, p in enumerate(_places(bits))]).mapInArrow(run, "key string, may boolean")


def missing(files: DataFrame, cached: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, source_file): keys of files (key, source_file) that cached lacks, each with the first file that has it. Only keys
    and names are shuffled, and only keys that the filter may know meet the cache."""
    first = files.groupBy("key").agg(F.min("source_file").alias("source_file"))
    tested = cut(may_know(first.select("key"), filter_words(cached, bits)))
    unsure = tested.where("may").select("key").join(cached.select("key"), "key", "left_anti")
    return first.join(tested.where("NOT may").select("key").union(unsure), "key", "left_semi")


def refresh(files: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame], version: str, bits: int = BITS) -> DataFrame:
    """What extract gives for files (source_file, text): cached where content and version are known, else extracted and
    written as a new generation. extract takes (source_file, text) and gives rows with source_file and a fixed schema.

    Files of equal content are extracted once and all get its rows. Repeated source_file rows with different texts are each
    read. Files without rows give none but are remembered. Without new contents no generation is written."""
    spark = files.sparkSession
    keyed = files.select("source_file", "text", content_key(F.col("text"), version).alias("key"))
    named = cut(keyed.select("source_file", "key"))
    cached = entries(spark, folder).where(F.col("extractor") == version).select("key")
    fresh = cut(missing(named, cached, bits))
    new = keyed.join(fresh, ["key", "source_file"], "left_semi").dropDuplicates(["key"])
    made = extract(new.select(F.col("key").alias("source_file"), F.coalesce("text", F.lit("")).alias("text"))).withColumnRenamed("source_file", "key")
    shape = [f for f in made.schema.fields if f.name != "key"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    if not fresh.isEmpty():
        to = f"{folder}/step-{_next(spark, folder):08d}"
        made.write.parquet(f"{to}/rows")
        fresh.select("key", F.lit(version).alias("extractor")).write.parquet(f"{to}/keys")
    return named.distinct().join(rows(spark, folder, version, schema), "key").drop("key").select("source_file", *[f.name for f in shape])


def compact(spark: SparkSession, folder: str, version: str, schema: str) -> str | None:
    """One base in place of all generations, with this version's keys and rows only. The generations before stay until the
    next compaction, for readers that have begun. Gives the base's name, or None where there is nothing to do."""
    before = generations(spark, folder)
    if len(before) < 2:
        return None
    name = f"base-{int(before[-1][5:]):08d}"
    kept = entries(spark, folder).where(F.col("extractor") == version)
    rows(spark, folder, version, schema).write.mode("overwrite").parquet(f"{folder}/{name}/rows")
    kept.select("key", "extractor").write.mode("overwrite").parquet(f"{folder}/{name}/keys")
    old = int(before[0][5:]) if before[0].startswith("base") else 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    for s in fs.listStatus(root):
        g = s.getPath().getName()
        if re.fullmatch(r"(step|base)-\d{8}", g) and (int(g[5:]) < old or (g.startswith("step") and int(g[5:]) == old)):
            fs.delete(s.getPath(), True)
    return name
