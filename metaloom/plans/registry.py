"""Queries by name with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def values(schema: str, rows: list[tuple]) -> str:
    """A relation of literal rows."""
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({schema})"


def per_supplier(schema: str, rows: list[tuple]) -> str:
    """The literal rows once for each row of supplier, with ~k~ turned into its key."""
    return per_part(schema, rows).replace("p_partkey", "s_suppkey").replace(" FROM part,", " FROM supplier,")


def for_suppliers(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """A template's rows once for each row of supplier, with ~k~ turned into its key in all strings."""
    template = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("_i"))
    made = keys.join(F.broadcast(template), "_i")
    return made.select(*[F.replace(c, F.lit("~k~"), F.col("_k")).alias(c) if t == "string" else F.col(c) for c, t in template.drop("_i").dtypes])


def per_part(schema: str, rows: list[tuple]) -> str:
    """The literal rows once for each row of part, with ~k~ turned into its key."""
    names = [n.strip() for n in schema.split(",")]
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    inner = values(", ".join(f"c{i}" for i in range(len(names))), rows)
    return "SELECT " + ", ".join(f"replace(c{i}, '~k~', CAST(p_partkey AS VARCHAR)) AS {n}" if t else f"c{i} AS {n}" for i, (n, t) in enumerate(zip(names, text))) + f" FROM part, ({inner}) AS v"
