"""Facts of stored procedures from their bodies, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.scalar import dynamic_sql_risk, matches

#: An identifier in any quoting, an optional schema before it; group 1 is the last part as written.
NAME = r"(?:[\[`\"]?\w+[\]`\"]?\s*\.\s*)?([\[`\"]?\w+[\]`\"]?)"


def found(body: Column, pattern: str) -> Column:
    """Distinct names at group 1, unquoted, sorted."""
    raw = F.regexp_extract_all(body, F.lit("(?i)" + pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.regexp_replace(x, r"[\[\]`\"]", ""))))


def tables(procs: DataFrame) -> DataFrame:
    """Reads without what is written or deleted, writes, deletes, all, crud and flags."""
    b = F.col("body")
    reads = F.array_sort(F.array_distinct(F.concat(found(b, r"\bFROM\s+" + NAME), found(b, r"\bJOIN\s+" + NAME))))
    writes = F.array_sort(F.array_distinct(F.concat(found(b, r"\bINSERT\s+INTO\s+" + NAME), found(b, r"\bUPDATE\s+" + NAME + r"\s+SET"))))
    deletes = found(b, r"\bDELETE\s+(?:FROM\s+)?" + NAME)
    crud = [("DELETE", F.size(deletes) > 0), ("INSERT", matches(b, r"\bINSERT\s+INTO\s+")), ("SELECT", matches(b, r"\bFROM\s+[\[`\"\w]")), ("UPDATE", matches(b, r"\bUPDATE\s+" + NAME + r"\s+SET"))]
    join = lambda x: F.array_join(x, ",")
    return procs.select(
        "proc", join(F.array_except(F.array_except(reads, writes), deletes)).alias("reads"), join(writes).alias("writes"), join(deletes).alias("deletes"), join(F.array_sort(F.array_union(F.array_union(reads, writes), deletes))).alias("tables"),
        join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in crud]))).alias("crud"), matches(b, r"\bBEGIN\s+TRAN(?:SACTION)?\b").alias("has_transaction"), b.rlike(r"#\w+").alias("has_temp"), dynamic_sql_risk(b).alias("dynamic_risk"),
    )


def calls(procs: DataFrame) -> DataFrame:
    """(caller, callee): procedures called by EXEC, system ones left out."""
    return procs.select(F.col("proc").alias("caller"), F.explode(found(F.col("body"), r"\bEXEC(?:UTE)?\s+" + r"(\w+)")).alias("callee")).where(~F.lower("callee").startswith("sp_"))


#: Business rules by what a body shows.
RULES = (
    ("conditional_write", r"(?s)\bIF\s*\(.+\)\s*(?:BEGIN\s+)?(?:INSERT|UPDATE|DELETE)"),
    ("raises_error", r"\bRAISERROR\b|\bTHROW\b"),
    ("existence_check", r"\bIF\s+(?:NOT\s+)?EXISTS\s*\(\s*SELECT"),
    ("row_count", r"@@ROWCOUNT"),
    ("return_code", r"\bRETURN\s+-?\d+"),
    ("cursor", r"\bDECLARE\s+\w+\s+CURSOR\b"),
)


def business_rules(procs: DataFrame) -> DataFrame:
    """P20: a row for each rule that a body shows."""
    hits = F.array_compact(F.array(*[F.when(matches(F.col("body"), p), F.lit(r)) for r, p in RULES]))
    return procs.select("proc", F.explode(hits).alias("rule"))


def transaction_depth(body: Column) -> Column:
    """P19."""
    return F.regexp_count(body, F.lit(r"(?i)\bBEGIN\s+TRAN(?:SACTION)?\b"))


#: Patterns of statements without a condition, of INSERT ... SELECT and of joins, with the characters looked ahead.
UPDATE_SET, DELETE_FROM = (r"\bUPDATE\s+\w+\s+SET\b", 500), (r"\bDELETE\s+(?:FROM\s+)?\w+", 280)
INSERT_SELECT = r"(?is)\bINSERT\s+INTO\s+(\w+)[^;]*?\bSELECT\b[^;]*?\bFROM\s+(\w+)"
JOIN_ON = r"(?is)\b((?:(?:LEFT|RIGHT|FULL|INNER|CROSS)\s+(?:OUTER\s+)?)?JOIN)\s+(\w+)\s+(?:AS\s+)?\w*\s*ON\s+(\w+\.\w+)\s*=\s*(\w+\.\w+)"


def risks(procs: DataFrame) -> DataFrame:
    """A row for each risk; UPDATE looks 500 characters ahead for a WHERE, DELETE 300."""
    b = F.col("body")
    after = lambda p, n: F.exists(F.regexp_extract_all(b, F.lit(rf"(?is)({p}.{{0,{n}}})"), F.lit(1)), lambda x: ~matches(x, r"\bWHERE\b"))
    flags = [("update_without_where", after(*UPDATE_SET)), ("delete_without_where", after(*DELETE_FROM)), ("injection", dynamic_sql_risk(b) == "HIGH"), ("deep_transactions", transaction_depth(b) > 2), ("cursor", matches(b, r"\bDECLARE\s+\w+\s+CURSOR\b")), ("no_error_handling", (transaction_depth(b) > 0) & ~matches(b, r"\bBEGIN\s+TRY\b|\bROLLBACK\b"))]
    return procs.select("proc", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags]))).alias("risk"))


def etl(procs: DataFrame) -> DataFrame:
    """INSERT INTO target ... SELECT ... FROM source."""
    p = F.lit(INSERT_SELECT)
    pairs = F.arrays_zip(F.regexp_extract_all("body", p, F.lit(1)).alias("t"), F.regexp_extract_all("body", p, F.lit(2)).alias("s"))
    return procs.select("proc", F.explode(pairs).alias("x")).select("proc", F.col("x.s").alias("source"), F.col("x.t").alias("target"))


def joins(procs: DataFrame) -> DataFrame:
    """Type, table and both sides of the first equality of each JOIN ... ON."""
    p = F.lit(JOIN_ON)
    part = lambda k: F.regexp_extract_all("body", p, F.lit(k))
    rows = procs.select("proc", F.explode(F.arrays_zip(part(1).alias("j"), part(2).alias("t"), part(3).alias("l"), part(4).alias("r"))).alias("x"))
    return rows.select("proc", F.upper("x.j").alias("join_type"), F.col("x.t").alias("tbl"), F.concat("x.l", F.lit(" = "), "x.r").alias("condition"))


def result_columns(procs: DataFrame, limit: int = 20) -> DataFrame:
    """The first SELECT list not fed into an INSERT; a star is one column, an alias wins, 20 columns at most."""
    listed = F.regexp_extract("body", r"(?is)^(?:(?!INSERT).)*?\bSELECT\s+(.+?)\s+FROM\b", 1)
    cols = procs.select("proc", F.posexplode(F.split(listed, ",")).alias("pos", "raw")).where(F.trim("raw") != "")
    alias = F.regexp_extract("raw", r"(?i)\bAS\s+(\w+)\s*$", 1)
    last = F.regexp_extract("raw", r"(\w+|\*)\s*$", 1)
    return cols.where(F.col("pos") < limit).select("proc", "pos", F.when(alias != "", alias).otherwise(last).alias("col"))


def rollup(procs: DataFrame) -> DataFrame:
    """Counts over all procedures."""
    t = tables(procs)
    write = F.col("crud").rlike("INSERT|UPDATE|DELETE")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(write).alias("commands"), F.count_if(~write).alias("queries"), F.count_if(F.col("dynamic_risk") != "NONE").alias("dynamic"), F.count_if(F.col("dynamic_risk") == "HIGH").alias("high"), F.count_if("has_transaction").alias("transactional"))
