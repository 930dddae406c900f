"""Queries of the catalog-wide operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metaloom.functions import rules as R
from metaloom.operators import catalog as C
from metaloom.plans import governance as GV
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add, for_suppliers, per_supplier

ents, fields, rels, cols, fks, views, idx, eps, repos = ((lambda n: (lambda s, d: frame(s, d, n)))(n) for n in ("fx_entities", "fx_fields", "fx_rels", "fx_columns", "fx_fks", "fx_views", "fx_indexes", "fx_endpoints", "fx_repos"))
add("W01_W07_first_wins", lambda s, d: C.first_wins(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], "event_id"), "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
add("W03_last_wins", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type")), "SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
add("W05_ordinals", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ordinal")), "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal FROM conversations")
add("S14_U06_merge", lambda s, d: C.merge(ents(s, d).where("aggregate IS NOT NULL").select("entity", "kind", "file"), ents(s, d).select("entity", "kind", "file"), "entity", "file"), f"{cte('fx_entities')} SELECT entity, kind, file FROM fx_entities")
_T = lambda c: f"'TABLE:' || {c}"
add("G03_property_graph", lambda s, d: C.property_graph(cols(s, d), fks(s, d), views(s, d), idx(s, d)), f"""{cte('fx_columns', 'fx_fks', 'fx_views', 'fx_indexes')}, e AS (SELECT {_T('tbl')} AS src, 'COLUMN:' || tbl || '.' || name AS dst, 'HAS_COLUMN' AS edge FROM fx_columns UNION ALL SELECT {_T('tbl')}, 'COLUMN:' || tbl || '.' || name, 'PK_COLUMN' FROM fx_columns WHERE is_pk
  UNION ALL SELECT 'COLUMN:' || tbl || '.' || col, 'COLUMN:' || ref_tbl || '.' || ref_col, 'REFERENCES' FROM fx_fks UNION ALL SELECT DISTINCT {_T('tbl')}, {_T('ref_tbl')}, 'FK_TO' FROM fx_fks UNION ALL SELECT 'VIEW:' || view, {_T('source')}, 'VIEW_READS' FROM fx_views UNION ALL SELECT 'INDEX:' || idx, 'COLUMN:' || tbl || '.' || col, 'INDEX_COVERS' FROM fx_indexes)
  SELECT *, dst NOT IN (SELECT {_T('tbl')} FROM fx_columns UNION SELECT 'COLUMN:' || tbl || '.' || name FROM fx_columns) AS dangling FROM e""")
add("V08_severity_rollup", lambda s, d: C.severity_rollup(GV.every(s, d)), f"{cte(*GV.TABLES)}, f AS ({GV.ALL}) SELECT rule, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'NOTE') AS note FROM f GROUP BY rule")
add("F35_missing_trails", lambda s, d: C.missing_trails(ents(s, d), fields(s, d)), f"{cte('fx_entities', 'fx_fields')} SELECT entity, 'missing_audit_trail' AS rule FROM fx_entities WHERE entity NOT IN (SELECT entity FROM fx_fields WHERE regexp_matches(field, '(?i){R.MODEL_AUDIT}')) UNION ALL SELECT entity, 'missing_soft_delete' FROM fx_entities WHERE kind = 'aggregate_root' AND entity NOT IN (SELECT entity FROM fx_fields WHERE regexp_matches(field, '(?i){R.SOFT_FLAG}'))")
_CHECKS = [("naming_recommendation", "NOTE", "LOW", "a.cs", 3, "RECOMMENDED"), ("naming_recommendation", "WARNING", "LOW", "a.cs", 3, "CONFIRMED"), ("lineage_gap", "NOTE", "HIGH", "a.cs", 3, "INFERRED"), ("schema_conflict", "CRITICAL", "HIGH", "a.cs", 9, "INFERRED"), ("missing_nav_property", "NOTE", "MEDIUM", "a.cs", 4, "INFERRED"), ("orphaned_fk", "WARNING", "HIGH", "", None, "CONFIRMED"), ("orphaned_fk", "WARNING", "MEDIUM", "", None, "INFERRED"), ("circular_dependency", "WARNING", "MEDIUM", None, None, "INFERRED"), ("pii_without_encryption", "WARNING", "HIGH", "", None, "CONFIRMED"), ("governance_gap", "WARNING", "LOW", "x.cs", 0, "INFERRED"), ("other", "WARNING", "LOW", "x.cs", 7, "CONFIRMED")]
add("X16_finding_type", lambda s, d: for_suppliers(s, d, [(i, *c[:5]) for i, c in enumerate(_CHECKS)], "no int, check string, severity string, confidence string, source_file string, line_number int").select("no", C.finding_type(*map(F.col, ("check", "severity", "confidence", "source_file", "line_number"))).alias("finding_type")), per_supplier("no, finding_type", [(i, c[5]) for i, c in enumerate(_CHECKS)]))
add("X22_flow_id", lambda s, d: eps(s, d).select(C.flow_id(F.col("method"), F.col("path")).alias("flow_id")), f"{cte('fx_endpoints')} SELECT method || '_' || replace(replace(replace(path, '/', '_'), '{{', ''), '}}', '') AS flow_id FROM fx_endpoints")
add("X08_X09_aggregate_of_path", lambda s, d: ents(s, d).select("entity", C.aggregate_of_path(F.col("file")).alias("aggregate_path")), f"{cte('fx_entities')} SELECT entity, CASE WHEN regexp_matches(file, '(^|/)src/[^/]+/') THEN regexp_extract(file, '(?:^|/)src/([^/]+)/', 1) ELSE list_extract(regexp_split_to_array(file, '[./]'), -1) END AS aggregate_path FROM fx_entities")
add("X21_entity_of_repo", lambda s, d: repos(s, d).select("repo", C.entity_of_repo(F.col("repo")).alias("inferred")), f"{cte('fx_repos')} SELECT repo, regexp_replace(repo, 'Repo(sitory)?$', '') AS inferred FROM fx_repos")
add("X20_G18_G19_types", lambda s, d: C.resolved_types(fields(s, d), ents(s, d)), f"{cte('fx_fields', 'fx_entities')}, t AS (SELECT entity, field, type, regexp_extract(type, '^(?:\\w+<)?(\\w+)\\??>?\\??$', 1) AS base FROM fx_fields) SELECT entity, field, base, CASE WHEN base IN (SELECT entity FROM fx_entities) AND contains(type, '<') THEN 'collection' WHEN base IN (SELECT entity FROM fx_entities) THEN 'entity' WHEN base IN ('int', 'long', 'string', 'decimal', 'DateTime', 'bool', 'Guid') THEN 'primitive' ELSE 'unresolved' END AS category FROM t")
add("P27_owners", lambda s, d: C.owners(fields(s, d), ents(s, d)), f"{cte('fx_fields', 'fx_entities')}, n AS (SELECT DISTINCT entity, regexp_extract(type, '(\\w+)>?$', 1) AS vo FROM fx_fields WHERE is_nav) SELECT e.entity AS vo, CAST(count(n.entity) AS INTEGER) AS n, string_agg(n.entity, ',' ORDER BY n.entity) AS owned_by FROM fx_entities e LEFT JOIN n ON n.vo = e.entity WHERE e.kind = 'value_object' GROUP BY e.entity")
add("J14_scalar_navigations", lambda s, d: C.scalar_navigations(fields(s, d), ents(s, d), rels(s, d).where("kind <> 'owns_one'")), f"{cte('fx_fields', 'fx_entities', 'fx_rels')} SELECT entity, type AS target, arg_min(field, pos) AS via FROM fx_fields f WHERE is_nav AND type NOT LIKE '%<%' AND type IN (SELECT entity FROM fx_entities) AND NOT EXISTS (SELECT 1 FROM fx_rels r WHERE kind <> 'owns_one' AND r.source = f.entity AND r.target = f.type) GROUP BY entity, type")
add("J15_key_pairs", lambda s, d: C.key_pairs(fields(s, d)), f"{cte('fx_fields')}, k AS (SELECT entity, field, regexp_extract(field, '^(.+)Id$', 1) AS target FROM fx_fields WHERE NOT is_nav AND regexp_matches(field, '^.+Id$')) SELECT k.entity, k.field, k.target, (SELECT arg_max(n.field, n.pos) FROM fx_fields n WHERE n.is_nav AND n.entity = k.entity AND regexp_extract(n.type, '(\\w+)>?$', 1) = k.target) AS nav FROM k")
add("K01_K03_document", lambda s, d: C.document(fks(s, d).select("fk", "tbl", "ref_tbl"), "foreign_keys", "fk"), f"""{cte('fx_fks')} SELECT '{{"foreign_keys":[' || string_agg('{{"fk":"' || fk || '","ref_tbl":"' || ref_tbl || '","tbl":"' || tbl || '"}}', ',' ORDER BY fk, ref_tbl, tbl) || ']}}' AS json FROM fx_fks""")
