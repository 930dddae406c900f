"""Queries of the governance rules."""

from __future__ import annotations

from metaloom.functions import rules as R
from metaloom.operators import governance as G
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add


def _m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){pattern}')"


F01 = f"SELECT tbl, name AS col, CASE WHEN {_m('name', R.PCI)} THEN 'pci_dss' WHEN {_m('name', R.PII_HIGH)} THEN 'pii_high' ELSE 'pii_medium' END AS rule, CASE WHEN {_m('name', R.PCI)} OR {_m('name', R.PII_HIGH)} THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM fx_columns WHERE {_m('name', R.PCI)} OR {_m('name', R.PII_HIGH)} OR {_m('name', R.PII_MEDIUM)}"
F02 = "SELECT DISTINCT tbl, '' AS col, 'missing_primary_key' AS rule, 'CRITICAL' AS severity FROM fx_columns c WHERE NOT EXISTS (SELECT 1 FROM fx_columns p WHERE p.tbl = c.tbl AND p.is_pk)"
F03 = f"SELECT DISTINCT tbl, '' AS col, 'missing_audit_columns' AS rule, 'WARNING' AS severity FROM fx_columns WHERE tbl NOT IN (SELECT tbl FROM fx_columns WHERE {_m('name', R.AUDIT)})"
F04 = "SELECT tbl, name AS col, 'nullable_primary_key' AS rule, 'CRITICAL' AS severity FROM fx_columns WHERE is_pk AND is_nullable"
F05 = "SELECT tbl, name AS col, 'nullable_foreign_key' AS rule, 'NOTE' AS severity FROM fx_columns WHERE is_fk AND is_nullable"
F06 = f"SELECT DISTINCT tbl, '' AS col, 'soft_delete_incomplete' AS rule, 'WARNING' AS severity FROM fx_columns WHERE {_m('name', R.SOFT_FLAG)} AND tbl NOT IN (SELECT tbl FROM fx_columns WHERE {_m('name', R.SOFT_DATE)})"
F07 = "SELECT tbl, '' AS col, 'wide_table' AS rule, 'NOTE' AS severity FROM fx_columns GROUP BY tbl HAVING count(*) > 30"
F08 = "SELECT tbl, '' AS col, 'naming_inconsistency' AS rule, 'NOTE' AS severity FROM fx_columns GROUP BY tbl HAVING count(*) > 3 AND count(*) FILTER (contains(name, '_')) > 0 AND count(*) FILTER (regexp_matches(name, '[A-Z]') AND NOT contains(name, '_')) > 0"
F09 = f"SELECT tbl, name AS col, 'encryption_gap' AS rule, 'CRITICAL' AS severity FROM fx_columns WHERE {_m('name', R.PLAIN_SENSITIVE)} AND (norm_type = 'string' OR split_part(lower(raw_type), '(', 1) IN ('varchar','nvarchar','char','nchar','text','ntext','string'))"
F10 = f"SELECT DISTINCT tbl, '' AS col, 'gdpr_retention_gap' AS rule, 'WARNING' AS severity FROM fx_columns WHERE {_m('name', R.PERSONAL)} AND tbl NOT IN (SELECT tbl FROM fx_columns WHERE {_m('name', R.RETENTION)})"
F11 = "SELECT tbl, arg_min(name, ordinal) AS col, 'missing_check_constraint' AS rule, 'NOTE' AS severity FROM fx_columns WHERE regexp_matches(upper(name), 'STATUS|TYPE|STATE|FLAG|KIND|CATEGORY') AND norm_type IN ('string', 'integer') AND tbl NOT IN (SELECT tbl FROM fx_checks) GROUP BY tbl"
F12 = f"SELECT tbl, name AS col, 'unprotected_business_key' AS rule, 'WARNING' AS severity FROM fx_columns WHERE {_m('name', R.NATURAL_KEY)} AND NOT is_pk AND NOT is_unique"
F13 = "SELECT DISTINCT tbl, ref_tbl AS col, 'orphan_fk_reference' AS rule, 'WARNING' AS severity FROM fx_fks WHERE lower(ref_tbl) NOT IN (SELECT lower(tbl) FROM fx_columns)"
F14 = "SELECT DISTINCT f.tbl, f.col, 'missing_fk_index' AS rule, 'WARNING' AS severity FROM fx_fks f WHERE f.pos = 0 AND lower(f.ref_tbl) IN (SELECT lower(tbl) FROM fx_columns) AND NOT EXISTS (SELECT 1 FROM fx_indexes i WHERE i.tbl = f.tbl AND i.col = f.col) AND NOT EXISTS (SELECT 1 FROM fx_columns c WHERE c.tbl = f.tbl AND c.name = f.col AND c.is_pk)"
F15 = "SELECT array_to_string(list_sort(list(DISTINCT tbl))[1:5], ',') AS tbl, lower(name) AS col, 'denormalization_risk' AS rule, 'NOTE' AS severity FROM fx_columns WHERE NOT is_pk AND NOT is_fk AND length(name) >= 4 GROUP BY lower(name) HAVING count(DISTINCT tbl) >= 4"
F16 = r"SELECT proc AS tbl, '' AS col, 'sql_injection_risk' AS rule, 'CRITICAL' AS severity FROM fx_procs WHERE regexp_matches(body, '(?i)\bEXEC\s*\(|\bSP_EXECUTESQL\b|EXECUTE\s*\(') AND regexp_matches(body, '(?i)@\w+\s*\+|N?''\s*\+\s*@')"
ALL = " UNION ALL ".join(f"({x})" for x in (F01, F02, F03, F04, F05, F06, F07, F08, F09, F10, F11, F12, F13, F14, F15, F16))
TABLES = ("fx_columns", "fx_fks", "fx_checks", "fx_indexes", "fx_procs")

cols = lambda s, d: frame(s, d, "fx_columns")
rule = lambda f, *r: lambda s, d: f(s, d).where("rule IN (" + ",".join(f"'{x}'" for x in r) + ")")
add("F01_sensitive_columns", lambda s, d: G.sensitive_columns(cols(s, d)), f"{cte('fx_columns')} {F01}")
for name, sql in (("F02_missing_primary_key", F02), ("F03_missing_audit_columns", F03), ("F06_soft_delete_incomplete", F06), ("F07_wide_table", F07), ("F08_naming_inconsistency", F08), ("F10_gdpr_retention_gap", F10)):
    add(name, rule(lambda s, d: G.table_rules(cols(s, d)), name[4:]), f"{cte('fx_columns')} {sql}")
add("F04_nullable_primary_key", rule(lambda s, d: G.nullable_keys(cols(s, d)), "nullable_primary_key"), f"{cte('fx_columns')} {F04}")
add("F05_nullable_foreign_key", rule(lambda s, d: G.nullable_keys(cols(s, d)), "nullable_foreign_key"), f"{cte('fx_columns')} {F05}")
add("F09_encryption_gap", lambda s, d: G.encryption_gap(cols(s, d)), f"{cte('fx_columns')} {F09}")
add("F11_missing_check_constraint", lambda s, d: G.missing_check(cols(s, d), frame(s, d, "fx_checks")), f"{cte('fx_columns', 'fx_checks')} {F11}")
add("F12_unprotected_business_key", lambda s, d: G.unprotected_business_key(cols(s, d)), f"{cte('fx_columns')} {F12}")
add("F13_orphan_fk_reference", lambda s, d: G.orphan_references(frame(s, d, "fx_fks"), cols(s, d)), f"{cte('fx_columns', 'fx_fks')} {F13}")
add("F14_missing_fk_index", lambda s, d: G.missing_fk_index(frame(s, d, "fx_fks"), cols(s, d), frame(s, d, "fx_indexes")), f"{cte('fx_columns', 'fx_fks', 'fx_indexes')} {F14}")
add("F15_denormalization_risk", lambda s, d: G.denormalization(cols(s, d)), f"{cte('fx_columns')} {F15}")
add("F16_sql_injection_risk", lambda s, d: G.injection_risk(frame(s, d, "fx_procs")), f"{cte('fx_procs')} {F16}")
every = lambda s, d: G.analyze(*(frame(s, d, t) for t in TABLES))
add("F17_analyze", lambda s, d: every(s, d), f"{cte(*TABLES)} {ALL}")
add("A10_quality_score", lambda s, d: G.summary(every(s, d), cols(s, d)), f"""{cte(*TABLES)}, found AS ({ALL}), t AS (SELECT count(DISTINCT tbl) AS n FROM fx_columns),
  s AS (SELECT greatest(0, CAST(round_even(100 - (5 * count(*) FILTER (severity = 'CRITICAL') + 2 * count(*) FILTER (severity = 'WARNING') + count(*) FILTER (severity = 'NOTE')) / any_value(n), 0) AS INTEGER)) AS score FROM found, t)
  SELECT rule, severity, count(*) AS n_findings, any_value(score) AS score FROM found, s GROUP BY rule, severity""")

_audit = _m("field", R.MODEL_AUDIT)
add("F20_F23_model_rules", lambda s, d: G.model_rules(frame(s, d, "fx_entities"), frame(s, d, "fx_fields")), f"""{cte('fx_entities', 'fx_fields')}
  SELECT entity, field, 'pii' AS rule, CASE WHEN pii = 'high' THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM fx_fields WHERE pii IS NOT NULL
  UNION ALL SELECT entity, '', 'audit_trail', 'WARNING' FROM fx_entities WHERE kind NOT IN ('value_object', 'dto', 'projection') AND entity NOT IN (SELECT entity FROM fx_fields WHERE {_audit})
  UNION ALL SELECT entity, field, 'data_integrity', 'CRITICAL' FROM fx_fields WHERE is_pk AND is_nullable
  UNION ALL SELECT entity, '', 'aggregate_design', 'WARNING' FROM fx_entities WHERE kind = 'aggregate_root' AND entity NOT IN (SELECT entity FROM fx_fields WHERE is_pk)""")
_sens = _m("path", R.SENSITIVE_PATHS)
add("F24_auth_missing", lambda s, d: G.auth_missing(frame(s, d, "fx_endpoints")), f"""{cte('fx_endpoints')} SELECT method, path, CASE WHEN {_sens} THEN 'CRITICAL' ELSE 'WARNING' END AS severity, CASE WHEN {_sens} THEN 'CONFIRMED' ELSE 'INFERRED' END AS finding_type, CASE WHEN {_sens} THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
  FROM fx_endpoints WHERE NOT auth AND (method IN ('POST', 'PUT', 'PATCH', 'DELETE') OR {_sens})""")
add("F25_cross_domain_leakage", lambda s, d: G.cross_domain_leakage(frame(s, d, "fx_rels"), frame(s, d, "fx_entities")), f"""{cte('fx_rels', 'fx_entities')} SELECT r.source, r.target, r.kind, a.aggregate AS source_aggregate, b.aggregate AS target_aggregate FROM fx_rels r LEFT JOIN fx_entities a ON a.entity = r.source LEFT JOIN fx_entities b ON b.entity = r.target
  WHERE r.cross_domain AND r.kind IN ('one_to_many', 'many_to_many')""")
_rules = ", ".join(f"({i}, '(?i){p}', '{r}', '{c}', '{g}')" for i, (p, r, c, g) in enumerate(R.FIELD_PATTERNS))
F30 = f"SELECT f.entity, f.field, p.pattern, p.rule, p.confidence, p.category, CASE WHEN p.confidence = 'HIGH' THEN 'WARNING' ELSE 'NOTE' END AS severity FROM fx_fields f JOIN (VALUES {_rules}) AS p(pattern, regex, rule, confidence, category) ON regexp_matches(f.field, p.regex)"
add("F30_field_patterns", lambda s, d: G.field_patterns(frame(s, d, "fx_fields")), f"{cte('fx_fields')} {F30}")
add("F34_access_control", lambda s, d: G.access_control(frame(s, d, "fx_endpoints")), f"{cte('fx_endpoints')} SELECT method, path, CASE WHEN auth THEN 'access_control' ELSE 'anonymous_access' END AS rule, CASE WHEN auth THEN 'NOTE' ELSE 'WARNING' END AS severity FROM fx_endpoints WHERE auth OR (method = 'GET' AND NOT anon)")
add("F36_first_findings", lambda s, d: G.first_findings(G.field_patterns(frame(s, d, "fx_fields"))), f"""{cte('fx_fields')}, hit AS ({F30}), one AS (SELECT entity, field, rule, arg_min(confidence, pattern) AS confidence FROM hit GROUP BY ALL)
  SELECT *, CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rule, entity, field) AS INTEGER) AS position FROM one""".replace("GROUP BY ALL", "GROUP BY entity, field, rule"))
add("F37_count_by", lambda s, d: G.field_patterns(frame(s, d, "fx_fields")).groupBy("rule", "category").count().withColumnRenamed("count", "n"), f"{cte('fx_fields')}, hit AS ({F30}) SELECT rule, category, count(*) AS n FROM hit GROUP BY rule, category")
