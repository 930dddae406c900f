"""Queries of the graph operators: small graphs, the key graph of the tables, and accesses read from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import catalog_graph as CG
from metaloom.operators import ddl as D
from metaloom.operators import graph as G
from metaloom.operators import lineage as L
from metaloom.operators import procedures as P
from metaloom.plans import ddl
from metaloom.plans.fixtures import CATALOGS, cte, frame
from metaloom.plans.registry import add
from metaloom.sources.scratch import cut

CATALOGS["fx_keys"] = ("src string, dst string, kind string, pos int", [(a, b, "fk", i) for i, (a, b) in enumerate([("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"), ("labels", "documents")])])

SIMPLE = "e AS (SELECT src, dst, arg_max(kind, pos) AS kind FROM {t} GROUP BY src, dst)"
for name, t in (("G02_chains", "fx_edges"), ("G02_key_chains", "fx_keys")):
    add(name, lambda s, d, t=t: G.chains(frame(s, d, t)), f"""{cte(t)}, {SIMPLE.format(t=t)}, n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), starts AS (SELECT x FROM n ORDER BY x LIMIT 30),
  p(path, kinds) AS (SELECT [x], CAST([] AS VARCHAR[]) FROM starts UNION ALL SELECT list_append(path, e.dst), list_append(kinds, e.kind) FROM p JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst) AND len(path) < 6)
  SELECT array_to_string(path, '→') AS path, array_to_string(kinds, ',') AS kinds, CAST(len(path) - 1 AS INTEGER) AS depth, list_contains(kinds, 'write') AS has_write, CASE WHEN list_contains(kinds, 'write') THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM p WHERE len(path) > 1 AND (len(path) = 6 OR path[-1] NOT IN (SELECT src FROM e))""")
add("G04_simple_digraph", lambda s, d: G.simple(frame(s, d, "fx_edges")), f"{cte('fx_edges')} SELECT src, dst, arg_max(kind, pos) AS kind FROM fx_edges GROUP BY src, dst")
add("G05_G06_cycles", lambda s, d: G.cycles(frame(s, d, "fx_edges")), f"""{cte('fx_edges')}, e AS (SELECT DISTINCT src, dst FROM fx_edges), p(path, last) AS (SELECT [src], dst FROM e WHERE src <= dst UNION ALL SELECT list_append(path, last), e.dst FROM p JOIN e ON e.src = p.last WHERE last > path[1] AND NOT list_contains(path, last) AND len(path) < 6)
  SELECT array_to_string(path, '→') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p WHERE last = path[1]""")
_REACH = "r(src, dst, d) AS (SELECT src, dst, 1 FROM {t} WHERE src <> dst UNION SELECT r.src, e.dst, r.d + 1 FROM r JOIN {t} e ON e.src = r.dst WHERE e.src <> e.dst AND r.d < 12), q AS (SELECT src, dst, min(d) AS distance FROM r WHERE src <> dst GROUP BY src, dst)"
for name, t in (("G07_closure", "fx_edges"), ("G07_key_closure", "fx_keys")):
    add(name, lambda s, d, t=t: G.distances(frame(s, d, t)), f"{cte(t)}, {_REACH.format(t=t)} SELECT src, dst, CAST(distance AS INTEGER) AS distance FROM q")
add("G08_ego_graph", lambda s, d: G.ego(frame(s, d, "fx_edges"), "a", 3), f"{cte('fx_edges')}, r(node, hops) AS (SELECT dst, 1 FROM fx_edges WHERE src = 'a' UNION SELECT e.dst, r.hops + 1 FROM r JOIN fx_edges e ON e.src = r.node WHERE r.hops < 3) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r WHERE node <> 'a' GROUP BY node")
add("G09_dependency_depth", lambda s, d: G.dependency_depth(frame(s, d, "fx_edges")), f"{cte('fx_edges')}, {_REACH.format(t='fx_edges')} SELECT dst AS node, CAST(max(distance) AS INTEGER) AS depth, count(*) AS n_ancestors FROM q GROUP BY dst")
add("G10_cross_domain_paths", lambda s, d: G.cross_domain_paths(frame(s, d, "fx_edges"), frame(s, d, "fx_nodes")), f"""{cte('fx_edges', 'fx_nodes')}, e AS (SELECT DISTINCT src, dst FROM fx_edges WHERE src <> dst), h AS (SELECT src, dst, 1 AS hops, '' AS via FROM e UNION ALL SELECT a.src, b.dst, 2, a.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst),
  k AS (SELECT src, dst, hops, via, row_number() OVER (PARTITION BY src, dst ORDER BY hops, via) AS rn FROM h) SELECT k.src, k.dst, CAST(hops AS INTEGER) AS hops, via, x.domain AS src_domain, y.domain AS dst_domain FROM k JOIN fx_nodes x ON x.node = k.src JOIN fx_nodes y ON y.node = k.dst WHERE rn = 1 AND x.domain <> y.domain""")
_DEG = "SELECT coalesce(a.node, b.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) + coalesce(n_out, 0) >= 4 AS is_hub FROM (SELECT dst AS node, count(*) AS n_in FROM {t} GROUP BY 1) a FULL JOIN (SELECT src AS node, count(*) AS n_out FROM {t} GROUP BY 1) b ON a.node = b.node"
add("G11_degrees", lambda s, d: G.degrees(frame(s, d, "fx_edges")), f"{cte('fx_edges')} {_DEG.format(t='fx_edges')}")
add("G12_orphans", lambda s, d: G.orphans(frame(s, d, "fx_nodes"), frame(s, d, "fx_edges")), f"{cte('fx_nodes', 'fx_edges')} SELECT node FROM fx_nodes WHERE node NOT IN (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges)")
add("G13_call_depth", lambda s, d: G.call_depths(frame(s, d, "fx_procs"), P.calls(frame(s, d, "fx_procs"))), f"""{cte('fx_procs')}, c AS (SELECT lower(proc) AS a, lower(unnest(regexp_extract_all(body, '(?i)\\bEXEC(?:UTE)?\\s+(\\w+)', 1))) AS b FROM fx_procs), k AS (SELECT * FROM c WHERE NOT starts_with(b, 'sp_')),
  r(p, depth) AS (SELECT lower(proc), 0 FROM fx_procs WHERE lower(proc) NOT IN (SELECT b FROM k) UNION SELECT k.b, r.depth + 1 FROM r JOIN k ON k.a = r.p WHERE r.depth < 12) SELECT proc, CAST(coalesce(min(depth), 0) AS INTEGER) AS call_depth FROM fx_procs LEFT JOIN r ON r.p = lower(proc) GROUP BY proc""")
_RANK = "CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_NAME = "CASE r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"
add("G14_flows", lambda s, d: G.flows(frame(s, d, "fx_steps")), f"{cte('fx_steps')}, g AS (SELECT flow, string_agg(layer, '>' ORDER BY pos) AS layers, NOT bool_or(layer = 'entity') AS has_gaps, min({_RANK}) AS r FROM fx_steps GROUP BY flow) SELECT flow, layers, has_gaps, {_NAME} AS confidence FROM g")
add("G15_W04_flow_edges", lambda s, d: G.flow_edges(frame(s, d, "fx_steps")), f"{cte('fx_steps')}, g AS (SELECT flow, component AS src, lead(component) OVER w AS dst, least({_RANK}, lead({_RANK}) OVER w) AS r FROM fx_steps WINDOW w AS (PARTITION BY flow ORDER BY pos)) SELECT flow, src, dst, {_NAME} AS confidence FROM g WHERE dst IS NOT NULL")


def conversation_steps(s, d):
    """W04 over the conversations table: a turn is a step."""
    t = s.read.parquet(f"{d}/conversations.parquet")
    steps = t.select(F.col("conv_id").alias("flow"), F.col("turn").alias("pos"), F.col("role").alias("component"), F.lit("HIGH").alias("confidence"))
    return G.flow_edges(steps).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


add("W04_conversation_edges", conversation_steps, "SELECT role AS src, nxt AS dst, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY role, nxt")
add("G17_inheritance", lambda s, d: G.inheritance(frame(s, d, "fx_entities")), f"""{cte('fx_entities')}, r(entity, level, bases) AS (SELECT entity, 1, bases FROM fx_entities WHERE bases <> '' UNION ALL SELECT r.entity, r.level + 1, e.bases FROM r JOIN fx_entities e ON e.entity = split_part(r.bases, ',', 1) WHERE e.bases <> '' AND r.level < 5)
  SELECT entity, CAST(level AS INTEGER) AS level, bases FROM r""")


#: What an event says of a procedure and a table: its statement in the procedure's body.
_STATEMENTS = {"view": "SELECT * FROM T~", "click": "SELECT a FROM x.T~ WHERE a = 1", "purchase": "INSERT INTO T~ VALUES (1)", "signup": "UPDATE [T~] SET a = 1", "error": "DELETE FROM T~ WHERE a = 1"}


def bodies(s, d):
    """Procedures with a statement for each event of a user's day. Ten users share a hundred tables."""
    e = s.read.parquet(f"{d}/events.parquet")
    known = F.create_map(*[F.lit(x) for kv in _STATEMENTS.items() for x in kv])
    table = (F.get_json_object("props", "$.k").cast("long") + 100 * F.floor(F.col("user_id") / 10)).cast("string")
    one = F.replace(F.try_element_at(known, F.col("event_type")), F.lit("~"), table)
    proc = F.concat(F.lit("P"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"))
    return e.groupBy(proc.alias("proc")).agg(F.array_join(F.sort_array(F.collect_list(one)), ";\n").alias("body"))


def catalog(s, d):
    """Tables, views and keys of the part scripts, and the facts of the procedures; each is parsed once."""
    parts = ddl.parts(s, d)
    views = D.views(parts).select("view", F.explode(F.split("sources", ",")).alias("source"))
    return parts.where("origin = 'create'").select("tbl").distinct(), views, cut(P.tables(bodies(s, d))), D.foreign_keys(parts)


_ACCESS = "a AS (SELECT 'P' || user_id || '_' || strftime(ts, '%Y%m%d') AS proc, event_type, 'T' || (CAST(props->>'$.k' AS BIGINT) + 100 * (user_id // 10)) AS tbl, CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'delete' END AS kind FROM events), f AS (SELECT proc, tbl, bool_or(kind = 'read') AS r, bool_or(kind = 'write') AS w, bool_or(kind = 'delete') AS x FROM a GROUP BY proc, tbl)"
_EDGES = f"""WITH RECURSIVE {_ACCESS}, p AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part), e AS (
  SELECT tbl AS src, 'PROC:' || proc AS dst, 'proc_reads' AS edge, proc AS via FROM f WHERE r AND NOT w AND NOT x UNION ALL SELECT 'PROC:' || proc, tbl, 'proc_writes', proc FROM f WHERE w UNION ALL SELECT 'PROC:' || proc, tbl, 'proc_deletes', proc FROM f WHERE x
  UNION ALL SELECT 'T' || k, 'VIEW:V' || k, 'view_reads', 'V' || k FROM p UNION ALL SELECT 'U' || k, 'VIEW:V' || k, 'view_reads', 'V' || k FROM p UNION ALL SELECT 'T' || k, 'U' || k, 'fk_reference', 'other_id' FROM p UNION ALL SELECT 'U' || k, 'T' || k, 'fk_reference', 'No,Id' FROM p),
  t AS (SELECT 'T' || k AS tbl FROM p UNION ALL SELECT 'U' || k FROM p),
  i AS (SELECT src AS tbl, 'read_by' AS role, dst AS other FROM e WHERE edge IN ('view_reads', 'proc_reads') UNION ALL SELECT dst, 'written_by', src FROM e WHERE edge = 'proc_writes' UNION ALL SELECT dst, 'deleted_by', src FROM e WHERE edge = 'proc_deletes'
    UNION ALL SELECT src, 'fk_parents', dst FROM e WHERE edge = 'fk_reference' UNION ALL SELECT dst, 'fk_children', src FROM e WHERE edge = 'fk_reference'), m AS (SELECT tbl, role, other, count(*) AS times FROM i SEMI JOIN t USING (tbl) GROUP BY ALL)"""


def lineage(s, d):
    tables, views, facts, fks = catalog(s, d)
    return tables, L.edges(tables, views, facts, fks)


_COUNTS = "SELECT t.tbl, count(*) FILTER (role = 'read_by') AS n_read_by, count(*) FILTER (role = 'written_by') AS n_written_by, count(*) FILTER (role = 'deleted_by') AS n_deleted_by, count(*) FILTER (role = 'fk_parents') AS n_fk_parents, count(*) FILTER (role = 'fk_children') AS n_fk_children, count(DISTINCT other) FILTER (role IN ('read_by', 'written_by')) AS total_consumers FROM t LEFT JOIN m USING (tbl) GROUP BY t.tbl"
add("G01_lineage_edges", lambda s, d: lineage(s, d)[1], f"{_EDGES} SELECT src, dst, edge, via FROM e")
add("A04_table_impact", lambda s, d: L.impact(*lineage(s, d)), f"{_EDGES} SELECT * FROM m")
add("A04_A08_impact", lambda s, d: L.impact_counts(*lineage(s, d)), f"{_EDGES} {_COUNTS}")
add("O02_O03_top_impact", lambda s, d: L.impact_counts(*lineage(s, d)).select("tbl", "total_consumers").orderBy(F.desc("total_consumers"), "tbl").limit(30), f"{_EDGES} SELECT tbl, total_consumers FROM ({_COUNTS}) ORDER BY total_consumers DESC, tbl LIMIT 30")
add("A05_duplicate_transforms", lambda s, d: L.duplicate_readers(lineage(s, d)[1]), f"{_EDGES}, q AS (SELECT src AS tbl, dst AS reader FROM e WHERE edge IN ('view_reads', 'proc_reads') UNION SELECT dst, src FROM e WHERE edge IN ('proc_writes', 'proc_deletes')) SELECT tbl, reader, count(*) OVER (PARTITION BY tbl) AS n_readers FROM q QUALIFY count(*) OVER (PARTITION BY tbl) >= 3")
_CHAINS = f"""{_EDGES}, e1 AS (SELECT src, dst, arg_max(edge, CASE edge WHEN 'proc_deletes' THEN 3 WHEN 'proc_writes' THEN 2 WHEN 'fk_reference' THEN 4 ELSE 1 END) AS kind FROM e GROUP BY src, dst), starts AS (SELECT DISTINCT tbl FROM t ORDER BY tbl LIMIT 30),
  c(path, kinds) AS (SELECT [tbl], CAST([] AS VARCHAR[]) FROM starts UNION ALL SELECT list_append(path, e1.dst), list_append(kinds, e1.kind) FROM c JOIN e1 ON e1.src = path[-1] WHERE NOT list_contains(path, e1.dst) AND len(path) < 6),
  ch AS (SELECT array_to_string(path, '→') AS path, array_to_string(kinds, ',') AS kinds, CAST(len(path) - 1 AS INTEGER) AS depth, list_has_any(kinds, ['proc_writes', 'proc_deletes']) AS has_write FROM c WHERE len(path) > 1 AND (len(path) = 6 OR path[-1] NOT IN (SELECT src FROM e1)))"""
add("G02_lineage_chains", lambda s, d: L.lineage_chains(*lineage(s, d)), f"{_CHAINS} SELECT *, CASE WHEN has_write THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ch")


def totals(s, d):
    tables, views, facts, fks = catalog(s, d)
    edges = cut(L.edges(tables, views, facts, fks))
    return L.totals(tables, views, facts, edges, L.lineage_chains(tables, edges))


add("A03_lineage_totals", totals, f"{_CHAINS} SELECT edge AS what, count(*) AS n FROM e GROUP BY edge UNION ALL SELECT 'tables', count(*) FROM t UNION ALL SELECT 'views', count(*) FROM p UNION ALL SELECT 'procedures', count(DISTINCT proc) FROM f UNION ALL SELECT 'chains', count(*) FROM ch")
_PAIRS = "r(src, dst) AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM r JOIN {e} e ON e.src = r.dst)"
add("G05_lineage_components", lambda s, d: G.components(lineage(s, d)[1]), f"{_EDGES}, {_PAIRS.format(e='e')} SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
_DOWN = "edge IN ('fk_reference', 'view_reads', 'proc_writes')"
add("G06_lineage_cycles", lambda s, d: G.cycles(lineage(s, d)[1].where("edge IN ('fk_reference', 'view_reads')")), f"{_EDGES} SELECT a.src || '→' || a.dst AS cycle, 2 AS length FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND a.edge = 'fk_reference' AND b.edge = 'fk_reference'")
_FAR = f"g AS (SELECT DISTINCT src, dst FROM e WHERE {_DOWN} AND src <> dst), h(src, dst, n) AS (SELECT src, dst, 1 FROM g UNION SELECT h.src, g.dst, n + 1 FROM h JOIN g ON g.src = h.dst WHERE n < 8), q AS (SELECT src, dst, min(n) AS n FROM h WHERE src <> dst GROUP BY src, dst)"
add("G07_lineage_distances", lambda s, d: G.distances(lineage(s, d)[1].where(_DOWN)), f"{_EDGES}, {_FAR} SELECT src, dst, CAST(n AS INTEGER) AS distance FROM q")
add("G09_lineage_depth", lambda s, d: G.dependency_depth(lineage(s, d)[1].where(_DOWN)), f"{_EDGES}, {_FAR} SELECT dst AS node, CAST(max(n) AS INTEGER) AS depth, count(*) AS n_ancestors FROM q GROUP BY dst")
add("G09_lineage_ancestors", lambda s, d: G.ancestor_counts(lineage(s, d)[1]), f"{_EDGES}, {_PAIRS.format(e='e')} SELECT dst AS node, count(*) AS n_ancestors FROM r WHERE src <> dst GROUP BY dst")
_K = "SELECT CAST(p_partkey AS VARCHAR) AS k, p_size, CASE WHEN p_size % 2 = 0 THEN 'SET NULL' ELSE 'CASCADE' END AS act, CASE WHEN p_size % 3 = 0 THEN 'unique' ELSE '' END AS uni FROM part"
_COLS = "SELECT 'T' || k AS tbl, c, o, pk FROM k, (VALUES ('Id', 0, true), ('Price', 2, true), ('email', 3, false), ('other_id', 4, false)) v(c, o, pk) UNION ALL SELECT 'T' || k, 'kind' || p_size, 1, false FROM k UNION ALL SELECT 'U' || k, c, o, pk FROM k, (VALUES ('Id', 0, true), ('Name', 1, false), ('No', 2, false)) v(c, o, pk) UNION ALL SELECT 'T' || k, c, o, false FROM k, (VALUES ('Id', 0), ('email', 1)) v(c, o) WHERE p_size % 5 = 0"
_GRAPH = f"""WITH k AS ({_K}), c AS ({_COLS}), cons AS (SELECT 'T' || k AS tbl, 'PK_T' || k AS n FROM k UNION ALL SELECT 'U' || k, 'PK_U' || k FROM k UNION ALL SELECT 'T' || k, 'UQ_T' || k || '_0' FROM k UNION ALL SELECT 'T' || k, 'CHK_T' || k || '_0' FROM k),
  g AS (SELECT DISTINCT * FROM (SELECT 'TABLE:' || tbl AS src, 'COLUMN:' || tbl || '.' || c AS dst, 'HAS_COLUMN' AS edge, CAST(o AS VARCHAR) AS detail FROM c UNION ALL SELECT 'TABLE:' || tbl, 'COLUMN:' || tbl || '.' || c, 'PK_COLUMN', '' FROM c WHERE pk
    UNION ALL SELECT 'TABLE:T' || k, 'TABLE:U' || k, 'FK_TO', '|NO ACTION|CASCADE' FROM k UNION ALL SELECT 'TABLE:U' || k, 'TABLE:T' || k, 'FK_TO', 'fu' || k || '|' || act || '|NO ACTION' FROM k
    UNION ALL SELECT 'COLUMN:T' || k || '.other_id', 'COLUMN:U' || k || '.Id', 'REFERENCES', '' FROM k UNION ALL SELECT 'COLUMN:U' || k || '.No', 'COLUMN:T' || k || '.Id', 'REFERENCES', 'fu' || k FROM k UNION ALL SELECT 'COLUMN:U' || k || '.Id', 'COLUMN:T' || k || '.Price', 'REFERENCES', 'fu' || k FROM k
    UNION ALL SELECT 'TABLE:' || tbl, 'CONSTRAINT:' || n, 'HAS_CONSTRAINT', '' FROM cons UNION ALL SELECT 'VIEW:V' || k, 'TABLE:T' || k, 'VIEW_READS', '' FROM k UNION ALL SELECT 'VIEW:V' || k, 'TABLE:U' || k, 'VIEW_READS', '' FROM k
    UNION ALL SELECT 'PROCEDURE:P' || k, 'TABLE:T' || k, 'PROC_WRITES', '' FROM k UNION ALL SELECT 'PROCEDURE:P' || k, 'PROCEDURE:Log' || (p_size % 7), 'PROC_CALLS', '' FROM k UNION ALL SELECT 'TABLE:U' || k, 'INDEX:ix' || k, 'INDEXED_BY', uni FROM k
    UNION ALL SELECT 'INDEX:ix' || k, 'COLUMN:U' || k || '.No', 'INDEX_COVERS', '0' FROM k UNION ALL SELECT 'INDEX:ix' || k, 'COLUMN:U' || k || '.Name', 'INDEX_COVERS', '1' FROM k)),
  known AS (SELECT 'TABLE:' || tbl AS key FROM c UNION SELECT 'COLUMN:' || tbl || '.' || c FROM c UNION SELECT 'CONSTRAINT:' || n FROM cons UNION SELECT 'VIEW:V' || k FROM k UNION SELECT 'PROCEDURE:P' || k FROM k UNION SELECT 'PROCEDURE:F' || k FROM k UNION SELECT 'INDEX:ix' || k FROM k),
  n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id, key NOT IN (SELECT key FROM known) AS dangling FROM (SELECT key FROM known UNION SELECT src FROM g UNION SELECT dst FROM g))"""
add("G03_property_nodes", lambda s, d: CG.property_graph(ddl.parts(s, d))[0].select("id", "key", "node_type", "name", "dangling"), f"{_GRAPH} SELECT id, key, split_part(key, ':', 1) AS node_type, regexp_extract(key, '^[A-Z]+:(?:.*\\.)?(.*)$', 1) AS name, dangling FROM n")
add("G03_property_edges", lambda s, d: CG.property_graph(ddl.parts(s, d))[1], f"{_GRAPH} SELECT a.id AS src_id, b.id AS dst_id, edge, detail FROM g JOIN n a ON a.key = g.src JOIN n b ON b.key = g.dst")
add("P14_U01_event_tables", lambda s, d: P.tables(bodies(s, d)).select("proc", "reads", "writes", "deletes", "tables", "crud"), f"WITH {_ACCESS} SELECT proc, coalesce(string_agg(tbl, ',' ORDER BY tbl) FILTER (r AND NOT w AND NOT x), '') AS reads, coalesce(string_agg(tbl, ',' ORDER BY tbl) FILTER (w), '') AS writes, coalesce(string_agg(tbl, ',' ORDER BY tbl) FILTER (x), '') AS deletes, string_agg(tbl, ',' ORDER BY tbl) AS tables, any_value(crud) AS crud FROM f JOIN (SELECT proc, string_agg(DISTINCT c, ',' ORDER BY c) AS crud FROM (SELECT proc, unnest(CASE event_type WHEN 'purchase' THEN ['INSERT'] WHEN 'signup' THEN ['UPDATE'] WHEN 'error' THEN ['DELETE', 'SELECT'] ELSE ['SELECT'] END) AS c FROM a) GROUP BY proc) USING (proc) GROUP BY proc")
add("U01_read_only_tables", lambda s, d: P.tables(bodies(s, d)).select("proc", F.size(F.filter(F.split("reads", ","), lambda x: x != "")).cast("long").alias("n_read_only"), F.size(F.split("tables", ",")).cast("long").alias("n_all")), f"WITH {_ACCESS} SELECT proc, count(*) FILTER (r AND NOT w AND NOT x) AS n_read_only, count(*) AS n_all FROM f GROUP BY proc")
