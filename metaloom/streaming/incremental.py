"""Incremental extraction: a content-hash cache for batches, and a stream over a folder of scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CHARS = 24


def keyed(files: DataFrame) -> DataFrame:
    """Files with the key of their content."""
    return files.withColumn("key", F.substring(F.sha2("text", 256), 1, KEY_CHARS))


def fresh(files: DataFrame, cached: DataFrame) -> DataFrame:
    """One file for each content that the cache lacks."""
    return keyed(files).join(cached.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])


def hit_rate(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files, hits and their share to three places."""
    known = keyed(files).join(cached.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    return known.agg(F.count(F.lit(1)).alias("n_files"), F.count("hit").alias("n_hits")).withColumn("hit_rate", F.round(F.col("n_hits") / F.greatest("n_files", F.lit(1)), 3))


def follow(spark: SparkSession, folder: str, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a stream over the scripts dropped into folder: each micro-batch's fresh contents are extracted and appended
    to out, with their keys, so a content is extracted once whatever its name. Ends when all there is has been read."""

    def step(batch: DataFrame, _: int) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        files = batch.select(F.col("value").alias("text"), F.col("source_file"))
        new = fresh(files, spark.read.parquet(out)) if there else keyed(files).dropDuplicates(["key"])
        extract(new.select("source_file", "text")).join(new.select("source_file", "key"), "source_file").write.mode("append").parquet(out)

    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.sql").load(folder).withColumn("source_file", F.col("_metadata.file_path"))
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
