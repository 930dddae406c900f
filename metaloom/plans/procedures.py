"""Queries over procedure bodies."""

from __future__ import annotations

from metaloom.operators import procedures as P
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add

procs = lambda s, d: frame(s, d, "fx_procs")
W = cte("fx_procs")
_N = r"(?:\w+\s*\.\s*)?(\w+)"
_all = lambda p: f"regexp_extract_all(body, '(?i){p}', 1)"
_T = f"""t AS (SELECT proc, body, list_distinct(list_concat({_all(chr(92) + 'bFROM' + chr(92) + 's+' + _N)}, {_all(chr(92) + 'bJOIN' + chr(92) + 's+' + _N)})) AS r, list_distinct(list_concat({_all(chr(92) + 'bINSERT' + chr(92) + 's+INTO' + chr(92) + 's+' + _N)}, {_all(chr(92) + 'bUPDATE' + chr(92) + 's+' + _N + chr(92) + 's+SET')})) AS w, list_distinct({_all(chr(92) + 'bDELETE' + chr(92) + 's+(?:FROM' + chr(92) + 's+)?' + _N)}) AS x FROM fx_procs)"""
_DYN = r"CASE WHEN NOT regexp_matches(body, '(?i)\bEXEC\s*\(|\bSP_EXECUTESQL\b|EXECUTE\s*\(') THEN 'NONE' WHEN regexp_matches(body, '(?i)@\w+\s*\+|N?''\s*\+\s*@') THEN 'HIGH' WHEN regexp_matches(body, '(?i)\bSP_EXECUTESQL\b') THEN 'LOW' ELSE 'MEDIUM' END"
_TRAN = r"regexp_matches(body, '(?i)\bBEGIN\s+TRAN(?:SACTION)?\b')"
_CRUD = r"""array_to_string(list_filter([CASE WHEN len(x) > 0 THEN 'DELETE' END, CASE WHEN regexp_matches(body, '(?i)\bINSERT\s+INTO\s+') THEN 'INSERT' END, CASE WHEN regexp_matches(body, '(?i)\bFROM\s+\w') THEN 'SELECT' END, CASE WHEN regexp_matches(body, '(?i)\bUPDATE\s+\w+\s+SET') THEN 'UPDATE' END], lambda k: k IS NOT NULL), ',')"""
_FACTS = f"""SELECT proc, array_to_string(list_sort(list_filter(r, lambda k: NOT list_contains(w, k) AND NOT list_contains(x, k))), ',') AS reads, array_to_string(list_sort(w), ',') AS writes, array_to_string(list_sort(x), ',') AS deletes, array_to_string(list_sort(list_distinct(list_concat(r, w, x))), ',') AS tables,
  {_CRUD} AS crud, {_TRAN} AS has_transaction, regexp_matches(body, '#\\w+') AS has_temp, {_DYN} AS dynamic_risk FROM t"""
add("P14_P13_X10_proc_tables", lambda s, d: P.tables(procs(s, d)), f"{W}, {_T} {_FACTS}")
add("P14_calls", lambda s, d: P.calls(procs(s, d)), rf"{W}, c AS (SELECT DISTINCT proc AS caller, unnest(regexp_extract_all(body, '(?i)\bEXEC(?:UTE)?\s+(\w+)', 1)) AS callee FROM fx_procs) SELECT * FROM c WHERE NOT starts_with(lower(callee), 'sp_')")
add("P20_business_rules", lambda s, d: P.business_rules(procs(s, d)), f"{W} SELECT proc, rule FROM fx_procs JOIN (VALUES " + ", ".join(f"('{r}', '(?i){p}')" for r, p in P.RULES) + ") AS p(rule, regex) ON regexp_matches(body, p.regex)")
add("P21_risks", lambda s, d: P.risks(procs(s, d)), rf"""{W}
  SELECT proc, 'update_without_where' AS risk FROM fx_procs WHERE len(list_filter(regexp_extract_all(body, '(?is)(\bUPDATE\s+\w+\s+SET\b.{{0,500}})', 1), lambda k: NOT regexp_matches(k, '(?i)\bWHERE\b'))) > 0
  UNION ALL SELECT proc, 'delete_without_where' FROM fx_procs WHERE len(list_filter(regexp_extract_all(body, '(?is)(\bDELETE\s+(?:FROM\s+)?\w+.{{0,280}})', 1), lambda k: NOT regexp_matches(k, '(?i)\bWHERE\b'))) > 0
  UNION ALL SELECT proc, 'injection' FROM fx_procs WHERE {_DYN} = 'HIGH'
  UNION ALL SELECT proc, 'deep_transactions' FROM fx_procs WHERE len(regexp_extract_all(body, '(?i)\bBEGIN\s+TRAN(?:SACTION)?\b')) > 2
  UNION ALL SELECT proc, 'cursor' FROM fx_procs WHERE regexp_matches(body, '(?i)\bDECLARE\s+\w+\s+CURSOR\b')
  UNION ALL SELECT proc, 'no_error_handling' FROM fx_procs WHERE {_TRAN} AND NOT regexp_matches(body, '(?i)\bBEGIN\s+TRY\b|\bROLLBACK\b')""")
add("P22_etl", lambda s, d: P.etl(procs(s, d)), rf"{W}, x AS (SELECT proc, unnest(regexp_extract_all(body, '(?is)(\bINSERT\s+INTO\s+\w+[^;]*?\bSELECT\b[^;]*?\bFROM\s+\w+)', 1)) AS m FROM fx_procs) SELECT proc, regexp_extract(m, '(?is)\bFROM\s+(\w+)$', 1) AS source, regexp_extract(m, '(?is)\bINTO\s+(\w+)', 1) AS target FROM x")
add("P18_P23_joins", lambda s, d: P.joins(procs(s, d)), rf"""{W}, x AS (SELECT proc, unnest(regexp_extract_all(body, '(?is)(\b(?:(?:LEFT|RIGHT|FULL|INNER|CROSS)\s+(?:OUTER\s+)?)?JOIN\s+\w+\s+(?:AS\s+)?\w*\s*ON\s+\w+\.\w+\s*=\s*\w+\.\w+)', 1)) AS m FROM fx_procs)
  SELECT proc, upper(regexp_extract(m, '(?i)^(.*?JOIN)', 1)) AS join_type, regexp_extract(m, '(?i)JOIN\s+(\w+)', 1) AS tbl, regexp_extract(m, '(?i)\bON\s+(.*)$', 1) AS condition FROM x""")
add("P17_result_columns", lambda s, d: P.result_columns(procs(s, d)), rf"""{W}, x AS (SELECT proc, string_split(regexp_extract(split_part(upper(body), 'INSERT', 1), '(?is)\bSELECT\s+(.+?)\s+FROM\b', 1), ',') AS u, string_split(regexp_extract(left(body, length(split_part(upper(body), 'INSERT', 1))), '(?is)\bSELECT\s+(.+?)\s+FROM\b', 1), ',') AS c FROM fx_procs), y AS (SELECT proc, unnest(c) AS raw, unnest(range(len(c))) AS pos FROM x)
  SELECT proc, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(raw, '(?i)\bAS\s+\w+\s*$') THEN regexp_extract(raw, '(?i)\bAS\s+(\w+)\s*$', 1) ELSE regexp_extract(raw, '(\w+|\*)\s*$', 1) END AS col FROM y WHERE pos < 20 AND trim(raw) <> ''""")
add("A09_X11_rollup", lambda s, d: P.rollup(procs(s, d)), f"{W}, {_T}, f AS ({_FACTS}) SELECT count(*) AS n, count(*) FILTER (regexp_matches(crud, 'INSERT|UPDATE|DELETE')) AS commands, count(*) FILTER (NOT regexp_matches(crud, 'INSERT|UPDATE|DELETE')) AS queries, count(*) FILTER (dynamic_risk <> 'NONE') AS dynamic, count(*) FILTER (dynamic_risk = 'HIGH') AS high, count(*) FILTER (has_transaction) AS transactional FROM f")
