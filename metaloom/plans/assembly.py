"""Queries of the composed passes."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import functions as F

from metaloom.operators import assembly as A
from metaloom.operators import code as C
from metaloom.operators import stack as T
from metaloom.plans import code, models
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add, for_suppliers, per_part, per_supplier, values
from metaloom.sources.scratch import cut, new_dir

ents, fields, rels, eps, hands = ((lambda n: (lambda s, d: frame(s, d, n)))(n) for n in ("fx_entities", "fx_fields", "fx_rels", "fx_endpoints", "fx_handlers"))
_WORDS = [("HasMany m2m", "many_to_many"), ("ONE_TO_MANY", "one_to_many"), ("n_to_1", "many_to_one"), ("1_to_1", "one_to_one"), ("Owned type", "embeds"), ("cross_ref", "references"), ("?", "one_to_many")]
add("X14_relation_kinds", lambda s, d: for_suppliers(s, d, [(w,) for w, _ in _WORDS], "words string").select("words", A.relation_kind(F.col("words")).alias("kind")), per_supplier("words, kind", _WORDS))
_LEVELS = [("high", "HIGH"), ("0.85", "HIGH"), ("Medium", "MEDIUM"), ("0.65", "MEDIUM"), ("0.5", "LOW"), ("", "LOW")]
add("X14_confidence_levels", lambda s, d: for_suppliers(s, d, [(w,) for w, _ in _LEVELS], "words string").select("words", A.confidence_level(F.col("words")).alias("level")), per_supplier("words, level", _LEVELS))
_STYLES = [("Minimal API", "minimal_api"), ("RazorPages", "razor_page"), ("GraphQL", "graphql"), ("gRPC", "grpc"), ("mvc", "rest_controller")]
add("X14_endpoint_styles", lambda s, d: for_suppliers(s, d, [(w,) for w, _ in _STYLES], "words string").select("words", A.endpoint_style(F.col("words")).alias("style")), per_supplier("words, style", _STYLES))
add("U05_ordered_union", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.array_join(A.ordered_union(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("F"), F.substring("o_orderpriority", 1, 1), "o_orderstatus")), ",").alias("items")), "SELECT o_orderkey, o_orderstatus || ',' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',F' END || CASE WHEN left(o_orderpriority, 1) IN (o_orderstatus, o_orderpriority, 'F') THEN '' ELSE ',' || left(o_orderpriority, 1) END AS items FROM orders")
_AGG = "a AS (SELECT entity, min(aggregate) AS g FROM fx_entities WHERE coalesce(aggregate, '') <> '' GROUP BY entity)"
add("G20_enriched", lambda s, d: A.enriched(rels(s, d), fields(s, d), ents(s, d)).drop("pass_no"), f"""{cte('fx_rels', 'fx_fields', 'fx_entities')}, {_AGG}, b AS (SELECT entity, field, regexp_extract(field, '^(.+?)(?:Id|_id|ID)$', 1) AS x FROM fx_fields WHERE NOT is_nav AND regexp_matches(field, '^.+(Id|_id|ID)$')),
  n AS (SELECT entity AS source, x AS target, 'many_to_one' AS kind, field AS via, 1 AS p FROM b WHERE x IN (SELECT entity FROM fx_entities) AND x <> entity UNION SELECT DISTINCT target, source, 'one_to_many', via, 2 FROM fx_rels WHERE kind = 'many_to_one'),
  f AS (SELECT *, row_number() OVER (PARTITION BY source, target, via ORDER BY p) AS rn FROM n WHERE (source, target, via) NOT IN (SELECT (source, target, via) FROM fx_rels)), u AS (SELECT source, target, kind, via, confidence FROM fx_rels UNION ALL SELECT source, target, kind, via, 'MEDIUM' FROM f WHERE rn = 1)
  SELECT u.*, coalesce(x.g <> y.g, false) AS cross_domain FROM u LEFT JOIN a x ON x.entity = u.source LEFT JOIN a y ON y.entity = u.target""")


def of_code(s, d):
    """Relations of the made C# files: a configuration names its target by the property that it goes through."""
    files = code.files(s, d)
    found = cut(C.types(files))
    types = C.classes(found).select(F.col("name").alias("entity"), F.lit("").alias("aggregate"), F.col("is_value"))
    props = C.properties(found).select("entity", "name", "category", "target")
    by_property = props.select(F.col("entity").alias("source"), F.col("name").alias("via"), F.nullif("target", F.lit("")).alias("t"))
    configured = C.configured(files).join(by_property, ["source", "via"], "left").select("source", F.coalesce("t", "via").alias("target"), "kind", "via")
    return A.code_relations(configured, props, types)


add("G21_code_relations", of_code, per_part("source, target, kind, via, confidence, pass_no, cross_domain", [("Order~k~", "Line~k~", "one_to_many", "Lines", "HIGH", 1, False), ("Order~k~", "Customer", "many_to_one", "Customer", "HIGH", 1, False), ("Order~k~", "Address", "owns_one", "Home", "HIGH", 1, False), ("Order~k~", "Buyer", "references", "BuyerId", "MEDIUM", 3, False)]))


def of_catalog(s, d):
    return A.catalog_relations(frame(s, d, "fx_fks"), rels(s, d), frame(s, d, "fx_columns"), frame(s, d, "fx_views"))


_CATALOG = f"""{cte('fx_columns', 'fx_fks', 'fx_views', 'fx_rels')}, j AS (SELECT DISTINCT lower(tbl) AS a, lower(ref_tbl) AS b FROM fx_fks), t AS (SELECT DISTINCT tbl FROM fx_columns), v AS (
    SELECT tbl AS source, ref_tbl AS target, col AS via, 'HIGH' AS confidence, 1 AS pass_no FROM fx_fks UNION ALL SELECT source, target, via, confidence, 2 FROM fx_rels
    UNION ALL SELECT DISTINCT x.source, y.source, '', 'MEDIUM', 3 FROM fx_views x JOIN fx_views y ON x.view = y.view AND x.pos < y.pos AND lower(x.source) <> lower(y.source) WHERE (lower(x.source), lower(y.source)) NOT IN (SELECT (a, b) FROM j)
    UNION ALL SELECT c.tbl, t.tbl, c.name, 'LOW', 4 FROM fx_columns c JOIN t ON lower(t.tbl) IN (lower(regexp_extract(c.name, '(?i)^(.+?)_?id$', 1)), lower(regexp_extract(c.name, '(?i)^(.+?)_?id$', 1)) || 's') WHERE regexp_matches(c.name, '(?i)^(.+?)_?id$') AND lower(c.tbl) <> lower(t.tbl) AND (lower(c.tbl), lower(t.tbl)) NOT IN (SELECT (a, b) FROM j)),
  g AS (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target) ORDER BY CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, pass_no, source, via) AS rn FROM v), q AS (SELECT source, target, via, confidence, pass_no, pass_no >= 3 AS is_inferred, lower(source) = lower(target) AS is_self FROM g WHERE rn = 1)"""
add("G22_catalog_relations", lambda s, d: of_catalog(s, d), f"{_CATALOG} SELECT * FROM q")
add("G22_statistics", lambda s, d: A.relation_statistics(of_catalog(s, d)), f"{_CATALOG} SELECT count(*) AS n, count(*) FILTER (confidence = 'HIGH' AND NOT is_inferred) AS n_keys, count(*) FILTER (is_inferred) AS n_inferred, count(*) FILTER (is_self) AS n_self, count(*) FILTER (confidence = 'HIGH') AS n_high, count(*) FILTER (confidence = 'MEDIUM') AS n_medium, count(*) FILTER (confidence = 'LOW') AS n_low FROM q")
_E = "unnest(list_filter(string_split({c}, ','), lambda x: x <> ''))"
_PLACE = "generate_subscripts(list_filter(string_split({c}, ','), lambda x: x <> ''), 1)"
_one = lambda t, flow, c, n: f"SELECT {flow} AS flow, {n} AS l, {_PLACE.format(c=c)} AS i, {_E.format(c=c)} AS component FROM {t}"
_EP = "method || ' ' || path"
add("G14_traced", lambda s, d: A.traced(eps(s, d), hands(s, d), fields(s, d), ents(s, d)), f"""{cte('fx_endpoints', 'fx_handlers', 'fx_fields', 'fx_entities')}, h AS (SELECT {_EP} AS flow, 0 AS l, 1 AS i, {_EP} AS component FROM fx_endpoints UNION ALL SELECT handler, 0, 1, handler FROM fx_handlers UNION ALL {_one('fx_endpoints', _EP, 'services', 1)} UNION ALL {_one('fx_endpoints', _EP, 'repos', 2)} UNION ALL {_one('fx_handlers', 'handler', 'repos', 2)}
    UNION ALL SELECT * FROM ({_one('fx_endpoints', _EP, 'entities', 3)} UNION ALL {_one('fx_handlers', 'handler', 'entities', 3)}) WHERE component IN (SELECT entity FROM fx_entities)),
  k AS (SELECT * FROM h UNION ALL SELECT flow, 4, min(i), type FROM h JOIN (SELECT DISTINCT entity, type FROM fx_fields WHERE is_nav AND type NOT LIKE '%<%' AND type IN (SELECT entity FROM fx_entities WHERE kind = 'value_object')) f ON f.entity = h.component WHERE l = 3 GROUP BY flow, type)
  SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY l, i, component) - 1 AS INTEGER) AS pos, (['api', 'service', 'repository', 'entity', 'value_object'])[l + 1] AS layer, component FROM k
  UNION ALL SELECT DISTINCT 'gap:' || entity, 0, 'gap', entity FROM fx_entities WHERE kind <> 'value_object' AND entity NOT IN (SELECT component FROM h WHERE l = 3)""")
add("G15_injections", lambda s, d: A.injections(eps(s, d), hands(s, d)), f"{cte('fx_endpoints', 'fx_handlers')} SELECT DISTINCT flow AS src, component AS dst, CASE l WHEN 1 THEN 'service' ELSE 'repository' END AS kind FROM ({_one('fx_endpoints', _EP, 'services', 1)} UNION ALL {_one('fx_endpoints', _EP, 'repos', 2)} UNION ALL {_one('fx_handlers', 'handler', 'repos', 2)})")


def named_types(s, d):
    """G18 over the made C# files."""
    files = code.files(s, d)
    found = cut(C.types(files))
    types = C.classes(found)
    uses = C.properties(found).where("target <> ''").select(F.col("path").alias("file"), F.col("target").alias("type")).join(types.select(F.col("path").alias("file"), "ns").distinct(), "file")
    usings = C.symbols(files).where("kind = 'using'").select(F.col("path").alias("file"), F.col("name").alias("ns")).union(uses.select("file", F.lit("Shop.Shared")).distinct())
    shared = s.createDataFrame([("Shop.Shared", "Address")], "ns string, name string")
    return A.resolved_names(uses, types.select("ns", "name").union(shared), usings)


add("G18_resolved_names", named_types, per_part("file, type, full", [("Order~k~.cs", "Line~k~", "Shop.Orders~k~.Line~k~"), ("Order~k~.cs", "Address", "Shop.Shared.Address"), ("Order~k~.cs", "Buyer", "Buyer")]))
add("G19_aliases", lambda s, d: A.aliases(fields(s, d), ents(s, d), tuple(C.PRIMITIVES)), f"{cte('fx_fields', 'fx_entities')} SELECT entity, field AS property, regexp_replace(type, '\\?$', '') AS type, regexp_replace(type, '\\?$', '') IN (SELECT entity FROM fx_entities) OR regexp_replace(type, '\\?$', '') IN ({', '.join(repr(p) for p in C.PRIMITIVES)}) AS is_known FROM fx_fields WHERE is_nav AND type NOT LIKE '%<%'")
add("S13_adapters", lambda s, d: A.chosen_adapters(T.tech_context(models.stack(s, d))), "SELECT * FROM (" + values("place, adapter", [(0, "ef_core"), (2, "django"), (3, "nodejs")]) + ") WHERE EXISTS (SELECT 1 FROM supplier)")
add("S13_fallback", lambda s, d: A.chosen_adapters(s.read.parquet(f"{d}/supplier.parquet").select(F.lit("language").alias("kind"), F.concat(F.lit("cobol"), "s_suppkey").alias("name"))), values("place, adapter", [(0, "ef_core")]))
add("A21_clusters", lambda s, d: A.clusters(rels(s, d), ents(s, d)), f"{cte('fx_rels', 'fx_entities')}, e AS (SELECT DISTINCT entity, coalesce(aggregate, 'root') AS g FROM fx_entities), r AS (SELECT x.g AS a, y.g AS b FROM fx_rels JOIN e x ON x.entity = source JOIN e y ON y.entity = target) SELECT g AS aggregate, count(*) AS entities, (SELECT count(*) FROM r WHERE a = g AND b = g) AS internal, (SELECT count(*) FROM r WHERE a = g AND b <> g) AS external FROM e GROUP BY g")


def round_trip(s, d):
    """A relation written as JSON files and read again."""
    out = new_dir(s, "json")
    A.save(s.read.parquet(f"{d}/customer.parquet"), out)
    return A.load(s, out, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


add("K04_S11_json", round_trip, "SELECT * FROM customer")


_MADE = "CREATE TABLE a{k} (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL DEFAULT 'x'); CREATE TABLE b{k} (x INT, y INT, a_id INT REFERENCES a{k}(id) ON DELETE CASCADE, PRIMARY KEY (x, y));"


def sqlite_files(s, d):
    """(path, content): a SQLite file for each supplier."""

    def run(batches):
        for batch in batches:
            files = []
            for k in batch.column("k").to_pylist():
                con = sqlite3.connect(":memory:")
                con.executescript(_MADE.replace("{k}", str(k)))
                files.append(con.serialize())
                con.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.db" for k in batch.column("k").to_pylist()]), pa.array(files, pa.binary())], ["path", "content"])

    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k")).mapInArrow(run, "path string, content binary")


add("S04_sqlite_columns", lambda s, d: A.sqlite_columns(sqlite_files(s, d)), per_supplier("path, tbl, ordinal, name, raw_type, is_nullable, is_pk, default_value", [("~k~.db", "a~k~", 0, "id", "INTEGER", False, True, None), ("~k~.db", "a~k~", 1, "name", "VARCHAR(20)", False, False, "'x'"), ("~k~.db", "b~k~", 0, "x", "INT", False, True, None), ("~k~.db", "b~k~", 1, "y", "INT", False, True, None), ("~k~.db", "b~k~", 2, "a_id", "INT", True, False, None)]))
add("S04_sqlite_keys", lambda s, d: A.sqlite_keys(sqlite_files(s, d)), per_supplier("path, tbl, no, col, ref_tbl, ref_col, on_delete, on_update", [("~k~.db", "b~k~", 0, "a_id", "a~k~", "id", "CASCADE", "NO ACTION")]))
_ALIAS = "c_custkey % 100 <> 0"
_TO = "CASE WHEN c_custkey % 97 = 5 THEN c_custkey + 1 WHEN c_custkey % 97 = 6 THEN c_custkey - 1 ELSE c_custkey - 1 END"
add("G19_X20_alias_chains", lambda s, d: A.resolved_aliases(s.read.parquet(f"{d}/customer.parquet").where(_ALIAS).selectExpr("'N' || c_custkey AS name", f"'N' || ({_TO}) AS target")), f"WITH RECURSIVE a AS (SELECT 'N' || c_custkey AS name, 'N' || ({_TO}) AS target FROM customer WHERE {_ALIAS}), r(name, now, n) AS (SELECT name, target, 1 FROM a UNION ALL SELECT r.name, a.target, n + 1 FROM r JOIN a ON a.name = r.now WHERE n < 250) SELECT name, CASE WHEN max(n) >= 250 THEN NULL ELSE arg_max(now, n) END AS resolved, max(n) >= 250 AS is_cycle FROM r GROUP BY name")
