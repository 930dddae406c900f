"""Catalog-wide operators: merging models, first-wins, property graph, roll-ups, small classifiers and resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import rules as R
from metaloom.functions.scalar import matches


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by input position."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge(mine: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Mine, and of other what mine lacks, each key once."""
    return mine.unionByName(first_wins(other.join(mine.select(key).distinct(), key, "left_anti"), [key], order))


def property_graph(columns: DataFrame, fks: DataFrame, views: DataFrame, indexes: DataFrame) -> DataFrame:
    """Edges (src, dst, edge) of tables, columns, keys, views and indexes; dangling targets are marked."""
    t = lambda c: F.concat(F.lit("TABLE:"), c)
    col = lambda a, b: F.concat(F.lit("COLUMN:"), a, F.lit("."), b)
    c = F.col
    edges = [
        columns.select(t(c("tbl")).alias("src"), col(c("tbl"), c("name")).alias("dst"), F.lit("HAS_COLUMN").alias("edge")),
        columns.where("is_pk").select(t(c("tbl")), col(c("tbl"), c("name")), F.lit("PK_COLUMN")),
        fks.select(col(c("tbl"), c("col")), col(c("ref_tbl"), c("ref_col")), F.lit("REFERENCES")),
        fks.select(t(c("tbl")), t(c("ref_tbl")), F.lit("FK_TO")).distinct(),
        views.select(F.concat(F.lit("VIEW:"), c("view")), t(c("source")), F.lit("VIEW_READS")),
        indexes.select(F.concat(F.lit("INDEX:"), c("idx")), col(c("tbl"), c("col")), F.lit("INDEX_COVERS")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    known = columns.select(t(c("tbl")).alias("dst")).union(columns.select(col(c("tbl"), c("name")))).distinct().withColumn("known", F.lit(True))
    return out.join(known, "dst", "left").select("src", "dst", "edge", c("known").isNull().alias("dangling"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings by severity as columns, for each rule."""
    return findings.groupBy("rule").pivot("severity", ["CRITICAL", "WARNING", "NOTE"]).count().na.fill(0).select("rule", F.col("CRITICAL").alias("critical"), F.col("WARNING").alias("warning"), F.col("NOTE").alias("note"))


def missing_trails(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """entities without an audit name; aggregate roots without a soft-delete name."""
    f = fields.groupBy("entity").agg(F.bool_or(matches(F.col("field"), R.MODEL_AUDIT)).alias("audit"), F.bool_or(matches(F.col("field"), R.SOFT_FLAG)).alias("soft"))
    e = entities.join(f, "entity", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    hits = F.array_compact(F.array(F.when(no("audit"), "missing_audit_trail"), F.when(no("soft") & (F.col("kind") == "aggregate_root"), "missing_soft_delete")))
    return e.select("entity", F.explode(hits).alias("rule"))


def finding_type(check: Column, severity: Column, confidence: Column, source_file: Column, line_number: Column) -> Column:
    """What a check's finding is worth, by the first rule that holds."""
    anchored = (F.coalesce(source_file, F.lit("")) != "") & (F.coalesce(line_number, F.lit(0)) != 0)
    return (
        F.when((severity == "NOTE") & F.lower(check).contains("recommendation"), "RECOMMENDED")
        .when(check.isin("lineage_gap", "schema_conflict", "missing_nav_property"), "INFERRED")
        .when((confidence == "HIGH") & check.isin("orphaned_fk", "unresolved_relationship_target", "circular_dependency", "pii_without_encryption"), "CONFIRMED")
        .when(anchored, "CONFIRMED")
        .otherwise("INFERRED")
    )


def flow_id(method: Column, route: Column) -> Column:
    """METHOD_route without braces, slashes as underscores."""
    return F.concat(method, F.lit("_"), F.translate(route, "/{}", "_"))


def aggregate_of_path(path: Column) -> Column:
    """The folder after src, else the last folder of a namespace-like path."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)src/([^/]+)/", 1), F.lit("")), F.element_at(F.split(path, r"[./]"), -1))


def entity_of_repo(name: Column) -> Column:
    """The type argument of a repository, else its name without the suffix."""
    inner = F.regexp_extract(name, r"<(\w+)>", 1)
    return F.when(inner != "", inner).otherwise(F.regexp_replace(name, r"Repo(?:sitory)?$", ""))


def resolved_types(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """The inner type of each field; entity, collection, primitive or unresolved."""
    inner = F.regexp_replace(F.regexp_extract("type", r"^(?:\w+<)?(\w+)\??>?\??$", 1), r"\?$", "")
    known = entities.select(F.col("entity").alias("base"), F.lit(True).alias("known")).distinct()
    prim = F.col("base").isin("int", "long", "string", "decimal", "DateTime", "bool", "Guid")
    j = fields.withColumn("base", inner).join(known, "base", "left")
    return j.select("entity", "field", "base", F.when(F.col("known") & F.col("type").contains("<"), "collection").when(F.col("known"), "entity").when(prim, "primitive").otherwise("unresolved").alias("category"))


def owners(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Who owns each value object through navigations; null without owner, a sorted list with several."""
    vo = entities.where("kind = 'value_object'").select(F.col("entity").alias("vo"))
    nav = fields.where("is_nav").select("entity", F.regexp_extract("type", r"(\w+)>?$", 1).alias("vo")).distinct()
    g = vo.join(nav, "vo", "left").groupBy("vo").agg(F.sort_array(F.collect_list("entity")).alias("o"))
    return g.select("vo", F.size("o").alias("n"), F.when(F.size("o") > 0, F.array_join("o", ",")).alias("owned_by"))


def scalar_navigations(fields: DataFrame, entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Single navigations to entities that no relation covers yet, first field of a pair."""
    nav = fields.where("is_nav AND type NOT LIKE '%<%'").select("entity", F.col("type").alias("target"), "field", "pos")
    hit = nav.join(entities.select(F.col("entity").alias("target")).distinct(), "target").join(rels.select(F.col("source").alias("entity"), "target").distinct(), ["entity", "target"], "left_anti")
    return hit.groupBy("entity", "target").agg(F.min_by("field", "pos").alias("via"))


def key_pairs(fields: DataFrame) -> DataFrame:
    """Each key field with the navigation of the same target, if any (the last one)."""
    fk = fields.where("NOT is_nav").select("entity", "field", F.regexp_extract("field", r"^(.+)Id$", 1).alias("target")).where("target <> ''")
    nav = fields.where("is_nav").select("entity", F.regexp_extract("type", r"(\w+)>?$", 1).alias("target"), F.col("field").alias("nav"), "pos").groupBy("entity", "target").agg(F.max_by("nav", "pos").alias("nav"))
    return fk.join(nav, ["entity", "target"], "left").select("entity", "field", "target", "nav")


def document(rows: DataFrame, name: str, key: str) -> DataFrame:
    """A JSON document of all rows in key order; for catalog-sized relations."""
    each = rows.select(F.col(key).alias("k"), F.to_json(F.struct(*sorted(rows.columns))).alias("j"))
    return each.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "j"))), lambda x: x.j), ",").alias("l")).select(F.concat(F.lit(f'{{"{name}":['), "l", F.lit("]}")).alias("json"))
