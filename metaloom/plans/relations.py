"""Queries of relationship inference, redundancy and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import rules as R
from metaloom.functions import scalar as X
from metaloom.operators import redundancy as D
from metaloom.operators import relations as J
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add

KNOWN = "known AS (SELECT DISTINCT tbl AS known, lower(tbl) AS k FROM fx_columns)"
J01 = """SELECT f.tbl, known AS target, string_agg(col, ',' ORDER BY pos) AS cols, string_agg(ref_col, ',' ORDER BY pos) AS ref_cols,
  CASE WHEN count(*) = 1 AND (SELECT count(*) FROM fx_columns c WHERE c.tbl = f.tbl AND is_pk) = 1 AND (SELECT min(lower(name)) FROM fx_columns c WHERE c.tbl = f.tbl AND is_pk) = lower(min(col)) THEN 'one_to_one' ELSE 'many_to_one' END AS kind, lower(f.tbl) = lower(f.ref_tbl) AS self_ref
  FROM fx_fks f JOIN known ON lower(f.ref_tbl) = k GROUP BY f.tbl, f.fk, f.ref_tbl, known"""
J06 = """SELECT c.tbl, known AS target, name AS col FROM fx_columns c JOIN known ON k IN (lower(regexp_extract(name, '(?i)^(.+?)_?id$', 1)), lower(regexp_extract(name, '(?i)^(.+?)_?id$', 1)) || 's')
  WHERE regexp_matches(name, '(?i)^.+?_?id$') AND lower(c.tbl) <> k AND NOT EXISTS (SELECT 1 FROM fx_fks f WHERE lower(f.tbl) = lower(c.tbl) AND lower(f.ref_tbl) = k)"""
J08 = "SELECT DISTINCT a.source AS tbl, b.source AS target FROM fx_views a JOIN fx_views b ON a.view = b.view AND a.pos < b.pos AND lower(a.source) <> lower(b.source) WHERE NOT EXISTS (SELECT 1 FROM fx_fks f WHERE lower(f.tbl) = lower(a.source) AND lower(f.ref_tbl) = lower(b.source))"
cols, fks, views, rels, ents, fields = (lambda n: (lambda s, d: frame(s, d, n)))("fx_columns"), (lambda s, d: frame(s, d, "fx_fks")), (lambda s, d: frame(s, d, "fx_views")), (lambda s, d: frame(s, d, "fx_rels")), (lambda s, d: frame(s, d, "fx_entities")), (lambda s, d: frame(s, d, "fx_fields"))
add("J01_X12_fk_edges", lambda s, d: J.fk_edges(fks(s, d), cols(s, d)), f"{cte('fx_columns', 'fx_fks')}, {KNOWN} {J01}")
add("J02_X13_column_kinds", lambda s, d: J.column_kinds(cols(s, d), fks(s, d)), f"{cte('fx_columns', 'fx_fks')} SELECT tbl, name, CASE WHEN EXISTS (SELECT 1 FROM fx_fks f WHERE f.tbl = c.tbl AND f.col = c.name) THEN 'foreign_key' WHEN norm_type IN ('json', 'bytes') THEN 'embedded' ELSE 'primitive' END AS kind FROM fx_columns c")
add("J03_view_edges", lambda s, d: J.view_edges(views(s, d), cols(s, d)), f"{cte('fx_columns', 'fx_views')} SELECT view, source, CASE WHEN source IN (SELECT tbl FROM fx_columns) THEN 'view_reads' WHEN source IN (SELECT view FROM fx_views) THEN 'view_reads_view' ELSE 'dangling' END AS edge FROM fx_views")
add("J06_naming", lambda s, d: J.by_naming(cols(s, d), fks(s, d)), f"{cte('fx_columns', 'fx_fks')}, {KNOWN} {J06}")
add("J07_suffix", lambda s, d: J.by_suffix(fields(s, d), ents(s, d)), f"""{cte('fx_fields', 'fx_entities')}, b AS (SELECT entity, field, regexp_extract(field, '^(.+?)(?:Id|_id|ID)$', 1) AS x FROM fx_fields WHERE NOT is_nav AND regexp_matches(field, '^(.+?)(?:Id|_id|ID)$')),
  c AS (SELECT entity, field, 0 AS p, x AS t FROM b UNION ALL SELECT entity, field, 1, upper(x[1]) || lower(x[2:]) FROM b UNION ALL SELECT entity, field, 2, upper(x[1]) || x[2:] FROM b) SELECT entity, field, arg_min(t, p) AS target FROM c WHERE t IN (SELECT entity FROM fx_entities) AND t <> entity GROUP BY entity, field""")
add("J08_view_pairs", lambda s, d: J.view_pairs(views(s, d), fks(s, d)), f"{cte('fx_views', 'fx_fks')} {J08}")
add("J09_inverses", lambda s, d: J.inverses(rels(s, d)), f"{cte('fx_rels')} SELECT DISTINCT target AS source, source AS target, via, 'one_to_many' AS kind FROM fx_rels r WHERE kind = 'many_to_one' AND NOT EXISTS (SELECT 1 FROM fx_rels q WHERE q.source = r.target AND q.target = r.source AND q.via = r.via)")
add("J10_cross_domain", lambda s, d: J.cross_domain(rels(s, d), ents(s, d)), f"{cte('fx_rels', 'fx_entities')} SELECT r.source, r.target, r.via, coalesce(a.aggregate <> b.aggregate AND a.aggregate <> '' AND b.aggregate <> '', FALSE) AS is_cross FROM fx_rels r LEFT JOIN fx_entities a ON a.entity = r.source LEFT JOIN fx_entities b ON b.entity = r.target")
add("J13_relationship_scan", lambda s, d: ents(s, d).select("entity").join(rels(s, d).groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("o")), "entity", "left").join(rels(s, d).groupBy(F.col("target").alias("entity")).agg(F.count(F.lit(1)).alias("i")), "entity", "left").select("entity", F.coalesce("o", F.lit(0)).alias("depends_on"), F.coalesce("i", F.lit(0)).alias("depended_by")), f"{cte('fx_entities', 'fx_rels')} SELECT entity, (SELECT count(*) FROM fx_rels r WHERE r.source = entity) AS depends_on, (SELECT count(*) FROM fx_rels r WHERE r.target = entity) AS depended_by FROM fx_entities")
add("W02_best_relationship", lambda s, d: J.best(rels(s, d)).select("source", "target", "kind", "confidence", "pos"), f"{cte('fx_rels')}, r AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, pos) AS rn FROM fx_rels) SELECT source, target, kind, confidence, pos FROM r WHERE rn = 1")
G22 = f"""every AS (SELECT tbl, target, 'HIGH' AS confidence, 1 AS pass_no FROM ({J01}) UNION ALL SELECT tbl, target, 'MEDIUM', 3 FROM ({J08}) UNION ALL SELECT tbl, target, 'LOW', 4 FROM ({J06})), g AS (SELECT *, row_number() OVER (PARTITION BY lower(tbl), lower(target) ORDER BY pass_no, tbl, target) AS rn FROM every)"""
add("G22_U03_relationships", lambda s, d: J.relationships(cols(s, d), fks(s, d), views(s, d)), f"{cte('fx_columns', 'fx_fks', 'fx_views')}, {KNOWN}, {G22} SELECT tbl, target, confidence, pass_no FROM g WHERE rn = 1")
add("A06_confidence_breakdown", lambda s, d: J.relationships(cols(s, d), fks(s, d), views(s, d)).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")], F.count_if(F.lower("tbl") == F.lower("target")).alias("self_refs")), f"{cte('fx_columns', 'fx_fks', 'fx_views')}, {KNOWN}, {G22} SELECT count(*) AS n, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (lower(tbl) = lower(target)) AS self_refs FROM g WHERE rn = 1")
EDGES = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_orderkey", "events", "event_id")]


def inclusion_all(s, d):
    out = None
    for t, c, p, k in EDGES:
        part = J.inclusion(s.read.parquet(f"{d}/{t}.parquet"), s.read.parquet(f"{d}/{p}.parquet"), c, k).select(F.lit(f"{t}.{c}").alias("child"), F.lit(f"{p}.{k}").alias("parent"), "n_rows", "n_orphans")
        out = part if out is None else out.union(part)
    return out


add("J04_J17_inclusion", inclusion_all, " UNION ALL ".join(f"SELECT '{t}.{c}' AS child, '{p}.{k}' AS parent, count({c}) AS n_rows, count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p})) AS n_orphans FROM {t}" for t, c, p, k in EDGES))
add("F02_data_key_check", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").count().agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("count") > 1).alias("n_repeated")), "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
_members = "m AS (SELECT DISTINCT {o} AS owner, {f} AS feature FROM {t}), z AS (SELECT owner, count(*) AS n FROM m GROUP BY owner), c AS (SELECT x.owner AS a, y.owner AS b, count(*) AS common FROM m x JOIN m y ON x.feature = y.feature AND x.owner < y.owner GROUP BY 1, 2)"
_CLONE = "SELECT a, b, common, za.n + zb.n - common AS total FROM c JOIN z za ON za.owner = a JOIN z zb ON zb.owner = b WHERE za.n >= 2 AND zb.n >= 2 AND common >= 0.7 * (za.n + zb.n - common) - 1e-9"
add("J11_X23_entity_clones", lambda s, d: D.clones(fields(s, d).where("NOT is_nav").select(F.col("entity").alias("owner"), F.col("field").alias("feature"))), f"{cte('fx_fields')}, {_members.format(o='entity', f='field', t='fx_fields WHERE NOT is_nav')} {_CLONE}")
add("J11_U02_clone_findings", lambda s, d: D.clone_findings(fields(s, d).where("NOT is_nav").select(F.col("entity").alias("owner"), F.col("field").alias("feature"))), f"""{cte('fx_fields')}, g AS (SELECT entity, list_sort(list(DISTINCT field)) AS s FROM fx_fields WHERE NOT is_nav GROUP BY entity HAVING count(DISTINCT field) >= 2),
  p AS (SELECT x.entity AS a, y.entity AS b, x.s AS sa, y.s AS sb, len(list_intersect(x.s, y.s)) AS c FROM g x JOIN g y ON x.entity < y.entity), q AS (SELECT *, c / (len(sa) + len(sb) - c) AS share FROM p WHERE c / (len(sa) + len(sb) - c) >= 0.7)
  SELECT a, b, round_even(share * 100, 1) AS overlap_pct, CASE WHEN share >= 0.8 THEN 'WARNING' ELSE 'NOTE' END AS severity, CASE WHEN share >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, array_to_string(list_sort(list_intersect(sa, sb)), ',') AS shared,
    array_to_string(list_filter(sa, lambda v: NOT list_contains(sb, v)), ',') AS unique_a, array_to_string(list_filter(sb, lambda v: NOT list_contains(sa, v)), ',') AS unique_b FROM q""")
add("J11_supplier_clones", lambda s, d: D.clones(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 40).alias("feature"))), f"WITH {_members.format(o='l_suppkey', f='l_partkey % 40', t='lineitem')} {_CLONE}")
add("A11_repeated_fields", lambda s, d: D.repeated_fields(fields(s, d)), f"{cte('fx_fields')} SELECT field, count(DISTINCT entity) AS owners, count(DISTINCT type) = 1 AS same_type, count(DISTINCT entity) >= 4 AS actionable FROM fx_fields WHERE NOT is_nav AND lower(field) NOT IN ('id', 'name', 'createdat', 'updatedat', 'isdeleted') GROUP BY field HAVING count(DISTINCT entity) >= 3")
add("A12_shared_keys", lambda s, d: D.shared_keys(fields(s, d), ents(s, d)), f"{cte('fx_fields', 'fx_entities')} SELECT field, count(DISTINCT f.entity) AS owners, count(DISTINCT aggregate) AS aggregates FROM fx_fields f JOIN fx_entities e ON e.entity = f.entity WHERE regexp_matches(field, '(?i).+id$') GROUP BY field HAVING count(DISTINCT f.entity) >= 2 AND count(DISTINCT aggregate) >= 2")
add("A13_structural_duplicates", lambda s, d: D.structural(ents(s, d), fields(s, d)), f"{cte('fx_fields', 'fx_entities')}, f AS (SELECT entity, string_agg(field, ',' ORDER BY field) AS f FROM fx_fields GROUP BY entity), g AS (SELECT e.entity, array_to_string(list_sort(string_split(bases, ',')), ',') AS b, coalesce(f, '') AS f FROM fx_entities e LEFT JOIN f ON f.entity = e.entity) SELECT b AS bases, f AS fields, count(*) AS n, string_agg(entity, ',' ORDER BY entity) AS entities FROM g GROUP BY b, f HAVING count(*) >= 2")
_types = ", ".join(f"('{r}', '{n}')" for r, n in R.SQL_TYPES.items())
add("X01_normalize_sql_type", lambda s, d: frame(s, d, "fx_types").select("raw", X.normalize_sql_type(F.col("raw")).alias("norm")), f"{cte('fx_types')}, b AS (SELECT raw, trim(replace(replace(regexp_replace(lower(raw), '\\s*\\([^)]*\\)', '', 'g'), 'unsigned', ''), 'zerofill', '')) AS base FROM fx_types), m(r, n) AS (VALUES {_types}) SELECT raw, coalesce((SELECT max(n) FROM m WHERE r = base), CASE WHEN base = '' THEN 'unknown' ELSE base END) AS norm FROM b")
_codes = ", ".join(f"('{r}', '{n}')" for r, n in R.CODE_TYPES.items())
add("X02_normalize_type", lambda s, d: frame(s, d, "fx_code_types").select("raw", X.normalize_code_type(F.col("raw")).alias("norm")), f"{cte('fx_code_types')}, b AS (SELECT raw, trim(split_part(split_part(rtrim(raw, '?'), '<', 1), '[', 1)) AS base FROM fx_code_types), m(r, n) AS (VALUES {_codes}) SELECT raw, CASE WHEN raw = 'byte[]' THEN 'bytes' ELSE coalesce((SELECT max(n) FROM m WHERE r = base), CASE WHEN base = '' THEN 'unknown' ELSE lower(base) END) END AS norm FROM b")
_risk = lambda c: f"CASE WHEN regexp_matches({c}, '(?i){R.RISK_HIGH}') THEN 'high' WHEN regexp_matches({c}, '(?i){R.RISK_MEDIUM}') THEN 'medium' WHEN regexp_matches({c}, '(?i){R.RISK_LOW}') THEN 'low' END"
add("X03_column_risk", lambda s, d: cols(s, d).select("tbl", "name", X.column_risk(F.col("name")).alias("risk"), X.column_risk(F.col("name"), True).alias("risk_tokenized")), f"""{cte('fx_columns')} SELECT tbl, name, {_risk('name')} AS risk, {_risk("replace(regexp_replace(name, '([a-z])([A-Z])', '" + chr(92) + "1 " + chr(92) + "2', 'g'), '_', ' ')")} AS risk_tokenized FROM fx_columns""")
_bare = "CASE " + " ".join(f"WHEN tbl LIKE '%{x}' THEN left(tbl, length(tbl) - {len(x)})" for x in R.TABLE_SUFFIXES) + " ELSE tbl END"
add("X07_aggregate_of_table", lambda s, d: cols(s, d).select("tbl").distinct().withColumn("aggregate", X.aggregate_of_table(F.col("tbl"))), f"{cte('fx_columns')}, t AS (SELECT DISTINCT tbl, regexp_extract(tbl, '(?i)({R.DOMAIN_WORDS})', 1) AS w, {_bare} AS b FROM fx_columns) SELECT tbl, CASE WHEN w <> '' THEN upper(w[1]) || lower(w[2:]) WHEN b = '' THEN tbl ELSE upper(b[1]) || b[2:] END || 'Aggregate' AS aggregate FROM t")
add("A17_X18_X19_confidence", lambda s, d: frame(s, d, "fx_subjects").join(frame(s, d, "fx_evidence").groupBy("subject").agg(F.max("weight").alias("m"), F.count_if(F.col("weight") >= 0.8).alias("strong")), "subject", "left").select("subject", F.coalesce(F.when(F.col("strong") >= 2, F.least(F.lit(1.0), F.col("m") + 0.05)).otherwise(F.col("m")), F.lit(0.0)).alias("score")).withColumn("level", X.level_of(F.col("score"))), f"{cte('fx_subjects', 'fx_evidence')}, g AS (SELECT s.subject, max(weight) AS m, count(*) FILTER (weight >= 0.8) AS k FROM fx_subjects s LEFT JOIN fx_evidence e ON e.subject = s.subject GROUP BY s.subject), h AS (SELECT subject, coalesce(CASE WHEN k >= 2 THEN least(1.0, m + 0.05) ELSE m END, 0.0) AS score FROM g) SELECT subject, score, CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM h")
