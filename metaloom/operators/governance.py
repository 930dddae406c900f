"""Governance rules over a catalog of columns: column rules in one projection, table rules in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import rules as R
from metaloom.functions.scalar import matches, quality_score

SEVERITY = {
    "pci_dss": "CRITICAL", "pii_high": "CRITICAL", "pii_medium": "WARNING", "missing_primary_key": "CRITICAL", "missing_audit_columns": "WARNING", "nullable_primary_key": "CRITICAL", "nullable_foreign_key": "NOTE",
    "soft_delete_incomplete": "WARNING", "wide_table": "NOTE", "naming_inconsistency": "NOTE", "encryption_gap": "CRITICAL", "gdpr_retention_gap": "WARNING", "missing_check_constraint": "NOTE", "unprotected_business_key": "WARNING",
    "orphan_fk_reference": "WARNING", "missing_fk_index": "WARNING", "denormalization_risk": "NOTE", "sql_injection_risk": "CRITICAL",
}


def _found(df: DataFrame, rule: str) -> DataFrame:
    cols = df.columns
    return df.select("tbl", (F.col("name") if "name" in cols else F.lit("")).alias("col"), F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"))


def sensitive_columns(columns: DataFrame) -> DataFrame:
    """first of pci_dss, pii_high, pii_medium that the name matches."""
    n = F.col("name")
    rule = F.when(matches(n, R.PCI), "pci_dss").when(matches(n, R.PII_HIGH), "pii_high").when(matches(n, R.PII_MEDIUM), "pii_medium")
    severity = F.when(rule == "pii_medium", "WARNING").otherwise("CRITICAL")
    return columns.withColumns({"rule": rule, "severity": severity}).where("rule IS NOT NULL").select("tbl", F.col("name").alias("col"), "rule", "severity")


def nullable_keys(columns: DataFrame) -> DataFrame:
    """F04, F05."""
    return _found(columns.where("is_pk AND is_nullable"), "nullable_primary_key").union(_found(columns.where("is_fk AND is_nullable"), "nullable_foreign_key"))


def encryption_gap(columns: DataFrame) -> DataFrame:
    """a sensitive name stored as a plain string."""
    base = F.lower(F.trim(F.regexp_extract("raw_type", r"^([^(]*)", 1)))
    return _found(columns.where(matches(F.col("name"), R.PLAIN_SENSITIVE) & (base.isin(*R.STRING_TYPES) | (F.col("norm_type") == "string"))), "encryption_gap")


def unprotected_business_key(columns: DataFrame) -> DataFrame:
    """a natural key by name that is neither key nor unique."""
    return _found(columns.where(matches(F.col("name"), R.NATURAL_KEY) & ~F.col("is_pk") & ~F.col("is_unique")), "unprotected_business_key")


def table_profile(columns: DataFrame) -> DataFrame:
    """What the table rules need, one row a table."""
    n, any_of = F.col("name"), lambda p: F.bool_or(matches(F.col("name"), p))
    return columns.groupBy("tbl").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("is_pk").alias("has_pk"), any_of(R.AUDIT).alias("audit"), any_of(R.SOFT_FLAG).alias("flag"), any_of(R.SOFT_DATE).alias("date"), any_of(R.PERSONAL).alias("personal"), any_of(R.RETENTION).alias("retention"),
        F.bool_or(n.contains("_")).alias("snake"), F.bool_or(n.rlike("[A-Z]") & ~n.contains("_")).alias("camel"),
    )


def table_rules(columns: DataFrame) -> DataFrame:
    """F02, F03, F06, F07, F08, F10 from one aggregation."""
    rules = {
        "missing_primary_key": "NOT has_pk", "missing_audit_columns": "NOT audit", "soft_delete_incomplete": "flag AND NOT date", "wide_table": "n > 30", "naming_inconsistency": "n > 3 AND snake AND camel", "gdpr_retention_gap": "personal AND NOT retention",
    }
    hits = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(r).alias("rule"), F.lit(SEVERITY[r]).alias("severity"))) for r, p in rules.items()]))
    return table_profile(columns).select("tbl", F.explode(hits).alias("h")).select("tbl", F.lit("").alias("col"), "h.rule", "h.severity")


def missing_check(columns: DataFrame, checks: DataFrame) -> DataFrame:
    """the first status-like string or integer column of a table without checks."""
    like = columns.where(F.upper("name").rlike(R.STATUS_WORDS) & F.col("norm_type").isin("string", "integer")).join(checks.select("tbl").distinct(), "tbl", "left_anti")
    first = like.withColumn("rn", F.row_number().over(Window.partitionBy("tbl").orderBy("ordinal"))).where("rn = 1")
    return _found(first, "missing_check_constraint")


def orphan_references(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """foreign keys to unknown tables, case-insensitive, each (table, target) once."""
    known = columns.select(F.lower("tbl").alias("k")).distinct()
    return _found(fks.join(known, F.lower("ref_tbl") == F.col("k"), "left_anti").select("tbl", F.col("ref_tbl").alias("name")).distinct(), "orphan_fk_reference")


def missing_fk_index(fks: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """the first column of a key between known tables is in no index or primary key of its table."""
    known = columns.select(F.lower("tbl").alias("k")).distinct()
    covered = columns.where("is_pk").select("tbl", F.col("name").alias("col")).union(indexes.select("tbl", "col")).distinct()
    firsts = fks.where("pos = 0").join(known, F.lower("ref_tbl") == F.col("k"), "left_semi").select("tbl", "col").distinct()
    return _found(firsts.join(covered, ["tbl", "col"], "left_anti").select("tbl", F.col("col").alias("name")), "missing_fk_index")


def denormalization(columns: DataFrame) -> DataFrame:
    """a name of four letters or more, no key, in four tables or more; tables as a list of the first five."""
    plain = columns.where("NOT is_pk AND NOT is_fk AND length(name) >= 4")
    by = plain.groupBy(F.lower("name").alias("name")).agg(F.sort_array(F.collect_set("tbl")).alias("t")).where("size(t) >= 4")
    return _found(by.select(F.array_join(F.slice("t", 1, 5), ",").alias("tbl"), "name"), "denormalization_risk")


def injection_risk(procs: DataFrame) -> DataFrame:
    """F16."""
    from metaloom.functions.scalar import dynamic_sql_risk

    return _found(procs.where(dynamic_sql_risk(F.col("body")) == "HIGH").select(F.col("proc").alias("tbl")), "sql_injection_risk")


def analyze(columns: DataFrame, fks: DataFrame, checks: DataFrame, indexes: DataFrame, procs: DataFrame) -> DataFrame:
    """the findings of all rules."""
    parts = [sensitive_columns(columns), table_rules(columns), nullable_keys(columns), encryption_gap(columns), missing_check(columns, checks), unprotected_business_key(columns), orphan_references(fks, columns), missing_fk_index(fks, columns, indexes), denormalization(columns), injection_risk(procs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(findings: DataFrame, columns: DataFrame) -> DataFrame:
    """Rule counts with the score of the whole catalog on each row."""
    total = findings.agg(*[F.count_if(F.col("severity") == s).alias(a) for s, a in (("CRITICAL", "c"), ("WARNING", "w"), ("NOTE", "n"))])
    tables = columns.agg(F.countDistinct("tbl").alias("tables"))
    score = total.join(tables).select(quality_score(F.col("c"), F.col("w"), F.col("n"), F.col("tables")).alias("score"))
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_findings")).join(F.broadcast(score))


def model_rules(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Entity, field, rule, severity."""
    row = lambda df, field, rule, severity: df.select("entity", field.alias("field"), F.lit(rule).alias("rule"), (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"))
    pii = row(fields.where("pii IS NOT NULL"), F.col("field"), "pii", F.when(F.col("pii") == "high", "CRITICAL").otherwise("WARNING"))
    known = fields.groupBy("entity").agg(F.bool_or(matches(F.col("field"), R.MODEL_AUDIT)).alias("audit"), F.bool_or("is_pk").alias("pk"))
    both = entities.join(known, "entity", "left")
    audit = row(both.where(~F.col("kind").isin("value_object", "dto", "projection") & ~F.coalesce("audit", F.lit(False))), F.lit(""), "audit_trail", "WARNING")
    integrity = row(fields.where("is_pk AND is_nullable"), F.col("field"), "data_integrity", "CRITICAL")
    design = row(both.where((F.col("kind") == "aggregate_root") & ~F.coalesce("pk", F.lit(False))), F.lit(""), "aggregate_design", "WARNING")
    return pii.union(audit).union(integrity).union(design)


def auth_missing(endpoints: DataFrame) -> DataFrame:
    """F24."""
    sensitive = matches(F.col("path"), R.SENSITIVE_PATHS)
    hit = endpoints.where(~F.col("auth") & (F.col("method").isin(*R.WRITE_METHODS) | sensitive))
    return hit.select("method", "path", F.when(sensitive, "CRITICAL").otherwise("WARNING").alias("severity"), F.when(sensitive, "CONFIRMED").otherwise("INFERRED").alias("finding_type"), F.when(sensitive, "HIGH").otherwise("MEDIUM").alias("confidence"))


def cross_domain_leakage(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """F25."""
    agg = lambda side: entities.select(F.col("entity").alias(side), F.col("aggregate").alias(f"{side}_aggregate"))
    hit = rels.where("cross_domain AND kind IN ('one_to_many', 'many_to_many')")
    return hit.join(agg("source"), "source", "left").join(agg("target"), "target", "left").select("source", "target", "kind", "source_aggregate", "target_aggregate")


def field_patterns(fields: DataFrame) -> DataFrame:
    """every pattern that a field's name matches; one pass, patterns as an array of structs."""
    hits = F.array_compact(F.array(*[F.when(matches(F.col("field"), p), F.struct(F.lit(i).alias("pattern"), F.lit(rule).alias("rule"), F.lit(conf).alias("confidence"), F.lit(cat).alias("category"))) for i, (p, rule, conf, cat) in enumerate(R.FIELD_PATTERNS)]))
    return fields.select("entity", "field", F.explode(hits).alias("h")).select("entity", "field", "h.pattern", "h.rule", "h.confidence", "h.category", F.when(F.col("h.confidence") == "HIGH", "WARNING").otherwise("NOTE").alias("severity"))


def access_control(endpoints: DataFrame) -> DataFrame:
    """F34."""
    rule = F.when(F.col("auth"), "access_control").when((F.col("method") == "GET") & ~F.col("anon"), "anonymous_access")
    return endpoints.withColumn("rule", rule).where("rule IS NOT NULL").select("method", "path", "rule", F.when(F.col("rule") == "access_control", "NOTE").otherwise("WARNING").alias("severity"))


def first_findings(findings: DataFrame) -> DataFrame:
    """the first of (entity, field, rule) by pattern, ranked by confidence, then rule."""
    w = Window.partitionBy("entity", "field", "rule").orderBy("pattern")
    first = findings.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    order = Window.orderBy(F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2), "rule", "entity", "field")
    return first.select("entity", "field", "rule", "confidence", F.row_number().over(order).alias("position"))
