"""Checks and scores over a model: validation, domain design, roll-ups of entities, endpoints and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.operators.graph import cycles

#: Names from outside a model; relations may also point to the name for none.
EXTERNAL = ("Card", "AspNetUser", "IdentityUser")
NO_ENTITY = "Unknown"


def orphaned_keys(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Key fields XId whose X is neither an entity nor external."""
    fk = fields.where("NOT is_nav").select("entity", "field", F.regexp_extract("field", "^(.+)Id$", 1).alias("target")).where("target <> ''")
    known = entities.select(F.col("entity").alias("target")).distinct()
    return fk.where(~F.col("target").isin(*EXTERNAL)).join(known, "target", "left_anti").select("entity", "field", "target")


def unresolved_targets(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations to a target that is neither an entity nor external."""
    known = entities.select(F.col("entity").alias("target")).distinct()
    return rels.where(~F.col("target").isin(*EXTERNAL, NO_ENTITY)).join(known, "target", "left_anti").select("source", "target", "via")


def missing_navigation(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """A key field XId to entity X in an entity without a single navigation to X."""
    fk = fields.where("NOT is_nav").select("entity", "field", F.regexp_extract("field", "^(.+)Id$", 1).alias("target")).where("target <> ''")
    known = fk.join(entities.select(F.col("entity").alias("target")).distinct(), "target", "left_semi")
    navs = fields.where("is_nav AND type NOT LIKE '%<%'").select("entity", F.regexp_extract("type", r"(\w+)\??$", 1).alias("target")).distinct()
    return known.join(navs, ["entity", "target"], "left_anti").select("entity", "field", "target")


def circular_dependencies(rels: DataFrame) -> DataFrame:
    """Cycles of many_to_one, one_to_many and references relations, each once, as findings."""
    edges = rels.where("kind IN ('many_to_one', 'one_to_many', 'references') AND source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return cycles(edges).select(F.lit("circular_dependency").alias("check"), F.lit("WARNING").alias("severity"), "cycle", "length")


def lineage_gaps(entities: DataFrame, steps: DataFrame) -> DataFrame:
    """Entities in no flow that has an entity step."""
    seen = steps.where("layer = 'entity'").select(F.col("component").alias("entity")).distinct()
    return entities.join(seen, "entity", "left_anti").select("entity")


def name_conflicts(entities: DataFrame) -> DataFrame:
    """An entity's name in several aggregates, null counted as root."""
    a = F.coalesce("aggregate", F.lit("root"))
    return entities.groupBy("entity").agg(F.countDistinct(a).alias("n")).where("n > 1")


def unencrypted(findings: DataFrame) -> DataFrame:
    """(entity, field) with a finding of personal, card or credential data and none of encryption or sensitive data."""
    rule = F.col("rule")
    g = findings.groupBy("entity", "field").agg(F.bool_or(rule.isin("pii", "pci_dss", "credential")).alias("personal"), F.bool_or(rule.isin("encryption", "sensitive_data")).alias("safe"))
    return g.where("personal AND NOT safe").select("entity", "field")


def aggregate_roots(entities: DataFrame, fields: DataFrame, handlers: DataFrame) -> DataFrame:
    """Collections open to all, and guards (those of handlers that touch the entity)."""
    exposed = fields.where("is_nav AND getter = 'public' AND setter IN ('public', 'none') AND type LIKE 'List%'").groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("exposed"))
    guards = handlers.select(F.explode(F.split("entities", ",")).alias("entity"), "guards").groupBy("entity").agg(F.sum("guards").alias("g"))
    return entities.where("kind = 'aggregate_root'").join(exposed, "entity", "left").join(guards, "entity", "left").select("entity", F.coalesce("exposed", F.lit("")).alias("exposed"), (F.coalesce("g", F.lit(0)) > 0).alias("guarded"))


def value_objects(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """D02."""
    f = fields.groupBy("entity").agg(F.bool_or(F.lower("field") == "id").alias("has_id"), F.bool_or(F.col("setter").isin("public", "internal")).alias("has_setter"))
    v = entities.where("kind = 'value_object'").join(f, "entity", "left")
    issues = F.array_compact(F.array(F.when(F.col("has_id"), "has_id"), F.when(F.col("has_setter"), "mutable")))
    return v.select("entity", F.coalesce("has_id", F.lit(False)).alias("has_id"), F.coalesce("has_setter", F.lit(False)).alias("has_setter"), F.size(issues).alias("n_issues"))


def invariants(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Entities whose fields outsiders cannot set; the first five by position."""
    hidden = fields.where("NOT is_nav AND setter IN ('private', 'none')").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("pos", "field"))).alias("f"))
    return entities.join(hidden, "entity").select("entity", F.array_join(F.slice(F.transform("f", lambda x: x.field), 1, 5), ",").alias("fields"))


def boundaries(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """D04."""
    e = entities.withColumn("aggregate", F.coalesce("aggregate", F.lit("Unknown")))
    members = e.groupBy("aggregate").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("kind") == "aggregate_root").alias("roots"))
    cross = rels.where("cross_domain").join(e.select(F.col("entity").alias("source"), "aggregate"), "source").groupBy("aggregate").agg(F.count(F.lit(1)).alias("refs"))
    j = members.join(cross, "aggregate", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return j.withColumn("boundary", F.when((F.col("roots") == 1) & (F.col("refs") == 0), "well_bounded").when(F.col("roots") > 1, "multiple_roots").when(F.col("refs") > 0, "cross_domain_leakage").otherwise("no_root"))


def coupling(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Cross-domain relations by domain pair, the last one wins; an id is a reference, else a shared entity."""
    dom = lambda c: entities.select(F.col("entity").alias(c), F.coalesce("domain", F.lit("?")).alias(f"{c}_domain"))
    r = rels.where("cross_domain").join(dom("source"), "source").join(dom("target"), "target")
    kind = F.when(F.col("via").rlike("(?i)id$"), "id_reference").otherwise("shared_entity")
    return r.groupBy("source_domain", "target_domain").agg(F.max_by(kind, "pos").alias("coupling"))


def anti_corruption(entities: DataFrame) -> DataFrame:
    """D06."""
    return entities.where("entity LIKE '%Ordered%' OR entity LIKE '%Snapshot%'").select("entity")


def services_and_events(handlers: DataFrame) -> DataFrame:
    """Handlers without repositories; requests that are events."""
    kinds = F.array_compact(F.array(F.when(F.col("repos") == "", "domain_service"), F.when(F.col("request").contains("Event"), "domain_event")))
    return handlers.select("handler", F.explode(kinds).alias("kind"))


def health(entities: DataFrame, fields: DataFrame, handlers: DataFrame, rels: DataFrame) -> DataFrame:
    """50, plus and minus the weights of what the other passes find, within 0 and 100; one row."""
    roots = aggregate_roots(entities, fields, handlers).agg(F.coalesce(F.sum(F.lit(5) - F.when(F.col("exposed") != "", 3).otherwise(0) + F.when(F.col("guarded"), 2).otherwise(0)), F.lit(0)).alias("a"))
    vos = value_objects(entities, fields).agg(F.coalesce(F.sum(3 - 3 * F.col("n_issues")), F.lit(0)).alias("b"))
    ties = coupling(rels, entities).agg(F.coalesce(F.sum(F.when(F.col("coupling") == "id_reference", 1).otherwise(-5)), F.lit(0)).alias("c"))
    acl = anti_corruption(entities).agg((F.count(F.lit(1)) * 3).alias("d"))
    inv = invariants(entities, fields).agg(F.least(F.count(F.lit(1)) * 2, F.lit(20)).alias("e"))
    one = roots.join(vos).join(ties).join(acl).join(inv)  # one row each
    return one.select(F.least(F.lit(100), F.greatest(F.lit(0), 50 + F.col("a") + F.col("b") + F.col("c") + F.col("d") + F.col("e"))).cast("int").alias("score"))


def exposure(endpoints: DataFrame) -> DataFrame:
    """Per entity its endpoints and whether any writes, reads or lacks authorisation."""
    e = endpoints.select("method", "path", "auth", F.explode(F.split("entities", ",")).alias("entity")).where("entity <> ''")
    w = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    return e.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "method", "path"))), ",").alias("endpoints"), F.bool_or(w).alias("writes"), F.bool_or(~w).alias("reads"), F.bool_or(~F.col("auth")).alias("open"))


def usm_calls(endpoints: DataFrame, repos: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges endpoint to repository and handler, handler to repository and entity, repository to entity."""
    ep = F.concat_ws(" ", "method", "path")
    parts = lambda df, src, col, kind: df.select(src.alias("src"), F.explode(F.split(col, ",")).alias("dst")).where("dst <> ''").withColumn("edge", F.lit(kind))
    return parts(endpoints, ep, "repos", "endpoint_repo").union(parts(endpoints, ep, "services", "endpoint_handler")).union(parts(handlers, F.col("handler"), "repos", "handler_repo")).union(parts(handlers, F.col("handler"), "entities", "handler_entity")).union(repos.select("repo", "entity", F.lit("repo_entity")))


def endpoint_groups(endpoints: DataFrame) -> DataFrame:
    """A19."""
    return endpoints.groupBy(F.element_at(F.split("ns", r"\."), -1).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def domain_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges inside each domain."""
    dom = lambda c: nodes.select(F.col("node").alias(c), F.col("domain").alias(f"{c}_d"))
    inner = edges.join(dom("src"), "src").join(dom("dst"), "dst").where("src_d = dst_d").groupBy(F.col("src_d").alias("domain")).agg(F.count(F.lit(1)).alias("e"))
    return nodes.groupBy("domain").agg(F.count(F.lit(1)).alias("nodes")).join(inner, "domain", "left").select("domain", "nodes", F.coalesce("e", F.lit(0)).alias("internal_edges"))


def type_counts(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """A count for each kind of a fixed domain, zero included."""
    return kinds.join(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def adjacency(rels: DataFrame) -> DataFrame:
    """Distinct targets of each source, and how many of its relations cross domains."""
    return rels.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"), F.count_if("cross_domain").alias("n_cross"))


def erd_lines(rels: DataFrame) -> DataFrame:
    """A diagram line for each relation."""
    arrow = F.create_map(*[F.lit(x) for k, a in (("one_to_many", "||--o{"), ("many_to_one", "}o--||"), ("many_to_many", "}o--o{"), ("owns_one", "||--||")) for x in (k, a)])
    return rels.select(F.concat(F.col("source"), F.lit(" "), F.coalesce(F.try_element_at(arrow, F.col("kind")), F.lit("||--||")), F.lit(" "), F.col("target"), F.lit(' : "'), F.substring("via", 1, 30), F.lit('"')).alias("line"))


def coverage(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields, navigations and keys of each entity."""
    f = fields.groupBy("entity").agg(F.count_if(~F.col("is_nav")).alias("n_fields"), F.count_if("is_nav").alias("n_navs"), F.count_if("is_pk").alias("n_keys"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.join(f, "entity", "left").select("entity", z("n_fields"), z("n_navs"), z("n_keys"))


def model_summary(entities: DataFrame, rels: DataFrame, endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """One row of counts and sorted distinct aggregates."""
    n = lambda df, a: df.agg(F.count(F.lit(1)).alias(a))
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.array_join(F.sort_array(F.collect_set("aggregate")), ",").alias("aggregates"))
    return e.join(n(rels, "relationships")).join(n(endpoints, "endpoints")).join(n(handlers, "handlers"))  # one row each


def ranked_top(rows: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """The k rows of the highest by, names ascending among equals, with their place."""
    top = rows.orderBy(F.desc(by), name).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), name)))
