"""Scalar functions over names, types and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions import rules as R


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def _lookup(types: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in types.items() for x in pair])


def normalize_sql_type(raw: Column) -> Column:
    """Lower case, without a (...) part, unsigned and zerofill; unmapped text stays, empty is unknown."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"\s*\([^)]*\)", ""), "unsigned|zerofill", ""))
    return F.coalesce(F.try_element_at(_lookup(R.SQL_TYPES), base), F.when(base == "", "unknown").otherwise(base))


def normalize_code_type(raw: Column) -> Column:
    """Without ?, <...> and [...]; case-sensitive lookup, else lower case; byte[] is bytes."""
    base = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\?+$", ""), r"[<\[].*$", ""))
    return F.when(raw == "byte[]", "bytes").otherwise(F.coalesce(F.try_element_at(_lookup(R.CODE_TYPES), base), F.when(base == "", "unknown").otherwise(F.lower(base))))


def column_risk(name: Column, tokenized: bool = False) -> Column:
    """high, medium, low or null; tokenized also reads camelCase and snake_case words on their own."""
    text = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " ") if tokenized else name
    return F.when(matches(text, R.RISK_HIGH), "high").when(matches(text, R.RISK_MEDIUM), "medium").when(matches(text, R.RISK_LOW), "low")


def aggregate_of_table(name: Column) -> Column:
    """A domain word makes the aggregate; else the name without one suffix, first letter upper."""
    word = F.regexp_extract(name, f"(?i)({R.DOMAIN_WORDS})", 1)
    bare = F
    for s in R.TABLE_SUFFIXES:
        bare = bare.when(name.endswith(s), F.left(name, F.length(name) - len(s)))
    bare = bare.otherwise(name)
    bare = F.when(bare == "", name).otherwise(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 10_000)))
    word_up = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 10_000)))
    return F.concat(F.when(word != "", word_up).otherwise(bare), F.lit("Aggregate"))


def confidence_rank(level: Column) -> Column:
    return F.when(level == "HIGH", 3).when(level == "MEDIUM", 2).when(level == "LOW", 1).otherwise(0)


def level_of(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")


def quality_score(critical: Column, warning: Column, note: Column, tables: Column) -> Column:
    """100 less 5, 2 and 1 points a finding over the tables, at least 0; halves round to even."""
    return F.greatest(F.lit(0), F.bround(F.lit(100) - (5 * critical + 2 * warning + note) / tables).cast("int"))


#: Dynamic SQL, text put together for it, and its parameterised form.
DYNAMIC, CONCATENATED, PARAMETERISED = r"\bEXEC\s*\(|\bSP_EXECUTESQL\b|EXECUTE\s*\(", r"@\w+\s*\+|N?'\s*\+\s*@", r"\bSP_EXECUTESQL\b"


def dynamic_sql_risk(body: Column) -> Column:
    return F.when(~matches(body, DYNAMIC), "NONE").when(matches(body, CONCATENATED), "HIGH").when(matches(body, PARAMETERISED), "LOW").otherwise("MEDIUM")
