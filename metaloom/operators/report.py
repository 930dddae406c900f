"""Documents at the edge: Markdown (K05), and JSON documents of any size as sorted parts with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators.ranks import numbered
from metaloom.sources.scratch import cut


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row with a Markdown table; meant for report-sized rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    body = rows.select(F.struct(*order, line.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("l"))
    return body.select(F.concat_ws("\n", F.lit(head), F.transform("l", lambda r: r.line)).alias("markdown"))


def markdown_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(no, line) of a Markdown table of any length: two head lines, then a line for each row in order. Places come from
    running counts, so no task holds the table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = numbered(rows.select(*order, line.alias("line")), [F.col(c) for c in order], "no").select((F.col("no") + 2).alias("no"), "line")
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "no long, line string")
    return head.union(body)


def model_documents(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """A nested row for each table: (schema, tbl, fields, keys), the fields by ordinal, the keys by name and columns.
    Only one table's members meet in a row."""
    field = F.struct("ordinal", "name", "raw_type", "norm_type", "is_pk", "is_nullable")
    key = F.struct("name", "cols", "ref_tbl", "ref_cols", "on_delete", "on_update")
    by = ["source_file", "schema", "tbl"]
    f = columns.groupBy(*by).agg(F.sort_array(F.collect_list(field)).alias("fields"))
    k = keys.groupBy("source_file", "schema", "tbl").agg(F.sort_array(F.collect_list(key)).alias("keys"))
    return f.join(k, by, "left").withColumn("keys", F.coalesce("keys", F.array().cast(k.schema["keys"].dataType)))


def write_documents(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Nested rows as JSON lines below path/parts, each file a range of the order, and path/manifest: (part, first,
    last, n) with the order's values as one string. Gives the manifest. No task holds more than a range."""
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in order])
    dealt = rows.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("part", F.spark_partition_id())
    kept = cut(dealt.select("part", "_key", F.to_json(F.struct(*rows.columns)).alias("value")))
    kept.select("part", "value").write.partitionBy("part").text(f"{path}/parts")
    manifest = kept.groupBy("part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.count(F.lit(1)).alias("n"))
    manifest.write.json(f"{path}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The nested rows that write_documents wrote."""
    return spark.read.schema(schema).json(f"{path}/parts")
