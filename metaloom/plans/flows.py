"""Queries of the flow trace and the enterprise graph. The SQL walks from the heads on its own: lists are unnested with their
places, and each layer is a join of the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import code as C
from metaloom.operators import flows as W
from metaloom.plans import code
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add, per_part
from metaloom.sources.scratch import cut


def _arrays(df, *names):
    return df.withColumns({n: F.filter(F.split(n, ","), lambda x: x != "") for n in names})


def calls(s, d):
    return _arrays(frame(s, d, "fx_calls"), "services", "repos")


def asks(s, d):
    return _arrays(frame(s, d, "fx_asks"), "repos")


def traced(s, d):
    return W.trace(calls(s, d), asks(s, d), frame(s, d, "fx_entities"), frame(s, d, "fx_fields"))


_LIST = "list_filter(string_split({c}, ','), lambda x: x <> '')"
_OPEN = "SELECT id, kind, {stage} AS stage, generate_subscripts(" + _LIST + ", 1) AS nth, unnest(" + _LIST + ") AS component FROM h"
_IN = cte("fx_calls", "fx_asks", "fx_entities", "fx_fields")
_STEPS = f"""h AS (SELECT 'rest_api' AS kind, coalesce(method, '?') || '_' || replace(replace(replace(coalesce(path, '?'), '/', '_'), '{{', ''), '}}', '') AS id, coalesce(method, '?') || ' ' || coalesce(path, '?') AS flow, coalesce(auth, false) AS auth, request, response, services, repos, file, count(*) AS times FROM fx_calls GROUP BY ALL
    UNION ALL SELECT 'mediatr_handler', 'handler_' || cls, 'MediatR: ' || coalesce(request, 'Unknown'), false, NULL, NULL, '', repos, file, count(*) FROM fx_asks GROUP BY cls, request, response, repos, file),
  e AS (SELECT entity, max(file) AS file FROM fx_entities WHERE kind <> 'value_object' GROUP BY entity),
  q AS (SELECT id, kind, nth, component FROM ({_OPEN.format(stage=3, c='repos')})),
  n AS (SELECT q.*, e.entity FROM q JOIN e ON e.entity = regexp_extract(component, '<(\\w+)>', 1)),
  t AS (SELECT id, kind, 0 AS stage, 0 AS nth, 0 AS sub, 0 AS place, CASE kind WHEN 'rest_api' THEN 'api' ELSE kind END AS layer, CASE kind WHEN 'rest_api' THEN flow ELSE id[9:] END AS component, NULL AS direction, NULL AS via, NULL AS owner, 'HIGH' AS confidence FROM h
    UNION ALL SELECT id, kind, 1, 0, 0, 0, 'dto', request, 'inbound', NULL, NULL, 'HIGH' FROM h WHERE request <> ''
    UNION ALL SELECT id, kind, 2, nth, 0, 0, 'service', component, NULL, NULL, NULL, 'MEDIUM' FROM ({_OPEN.format(stage=2, c='services')})
    UNION ALL SELECT id, kind, 3, nth, 0, 0, 'repository', component, NULL, NULL, NULL, 'HIGH' FROM q
    UNION ALL SELECT id, kind, 3, nth, 1, 0, 'entity', entity, NULL, NULL, NULL, 'HIGH' FROM n
    UNION ALL SELECT id, n.kind, 3, nth, 2, f.pos, 'value_object', v.entity, NULL, f.field, n.entity, 'HIGH' FROM n JOIN fx_fields f ON f.entity = n.entity AND f.is_nav JOIN fx_entities v ON v.kind = 'value_object' AND v.entity = f.type WHERE n.kind = 'rest_api'
    UNION ALL SELECT id, kind, 4, 0, 0, 0, 'dto', response, 'outbound', NULL, NULL, 'HIGH' FROM h WHERE response <> ''),
  missed AS (SELECT * FROM e WHERE entity NOT IN (SELECT entity FROM n)),
  steps AS (SELECT id AS flow_id, CAST(row_number() OVER (PARTITION BY id, kind ORDER BY stage, nth, sub, place) - 1 AS INTEGER) AS pos, layer, component, direction, via, owner, confidence FROM t
    UNION ALL SELECT 'gap_' || entity, 0, 'entity', entity, NULL, NULL, NULL, 'HIGH' FROM missed),
  g AS (SELECT id, count(*) AS n_steps, count(DISTINCT component) FILTER (layer = 'entity') AS k, bool_or(confidence = 'MEDIUM') AS medium, bool_or(coalesce(direction = 'inbound', false)) AS asked FROM t GROUP BY id),
  flows AS (SELECT kind, id AS flow_id, flow, auth, file, times, n_steps, k = 0 AS has_gaps, CASE WHEN kind = 'rest_api' AND medium OR kind <> 'rest_api' AND k = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
      CASE WHEN kind = 'rest_api' THEN concat_ws(',', CASE WHEN auth THEN 'authentication' END, CASE WHEN k > 1 THEN 'cross_entity' END, CASE WHEN asked AND k > 0 THEN 'dto_transformation' END) ELSE '' END AS boundaries FROM h JOIN g USING (id)
    UNION ALL SELECT 'gap', 'gap_' || entity, 'Entity: ' || entity || ' (no direct API trace)', false, file, 1, 1, true, 'MEDIUM', '' FROM missed)"""


def flow_rows(s, d):
    flows, _ = traced(s, d)
    return flows.drop("flow_key").withColumn("boundaries", F.array_join("boundaries", ","))


def step_rows(s, d):
    flows, steps = traced(s, d)
    return steps.join(flows.select("flow_key", "flow_id"), "flow_key").drop("flow_key")


add("G14_flow_trace", flow_rows, f"{_IN}, {_STEPS} SELECT * FROM flows")
add("G14_flow_steps", step_rows, f"{_IN}, {_STEPS} SELECT * FROM steps")
add("G14_flow_totals", lambda s, d: W.totals(traced(s, d)[0]), f"{_IN}, {_STEPS} SELECT CAST(sum(times) AS BIGINT) AS flow_count, CAST(sum(times) FILTER (NOT has_gaps) AS BIGINT) AS complete_flows, CAST(sum(times) FILTER (has_gaps) AS BIGINT) AS gap_flows FROM flows")


def of_code(s, d):
    """Flows of the made C# files: endpoint classes, controllers and handlers with what is read of them."""
    files = code.files(s, d)
    typed = F.transform(F.filter(F.split("repos", ","), lambda r: r != ""), lambda r: F.concat(F.lit("IRepository<"), r, F.lit(">")))
    ends = C.endpoint_classes(files).withColumns({"services": F.array().cast("array<string>"), "repos": typed, "file": F.col("path"), "path": F.col("route")})
    found = C.controllers(files).withColumns({"services": F.array().cast("array<string>"), "repos": typed, "file": F.col("path"), "path": F.col("route"), "request": F.lit(""), "response": F.lit("")})
    hands = C.handlers(files).withColumns({"repos": typed, "file": F.col("path")})
    types = cut(C.types(files))
    rooted = C.classes(types).where("is_root OR is_value").select(F.col("name").alias("entity"), F.when(F.col("is_value"), "value_object").otherwise("entity").alias("kind"), F.col("path").alias("file"))
    props = C.properties(types).select("entity", F.lit(0).alias("pos"), F.col("name").alias("field"), "type", (F.col("category") == "navigation").alias("is_nav"))
    flows, _ = W.trace(ends.unionByName(found.select(*ends.columns)), hands, rooted, props)
    return flows.select("kind", "flow", "auth", "file", "times", "n_steps", "has_gaps", "confidence", F.array_join("boundaries", ",").alias("boundaries"))


add("G14_code_flows", of_code, per_part("kind, flow, auth, file, times, n_steps, has_gaps, confidence, boundaries", [
    ("rest_api", "POST /create/~k~", True, "Create~k~.cs", 1, 4, False, "HIGH", "authentication,dto_transformation"), ("rest_api", "GET /unknown", False, "Bare~k~.cs", 1, 5, True, "HIGH", ""),
    ("rest_api", "GET /Ctl~k~", False, "Ctl~k~.cs", 1, 1, True, "HIGH", ""), ("rest_api", "DELETE /Ctl~k~", False, "Ctl~k~.cs", 1, 1, True, "HIGH", ""), ("mediatr_handler", "MediatR: Ask~k~", False, "Handle~k~.cs", 1, 2, True, "MEDIUM", ""),
]))


def graph(s, d):
    flows, steps = traced(s, d)
    ends, hands, pages = calls(s, d), asks(s, d), _arrays(frame(s, d, "fx_screens"), "entities")
    flagged = frame(s, d, "fx_fields").where("pii = 'high'").select("entity")
    return W.enterprise_graph(ends, hands, pages, frame(s, d, "fx_dtos"), frame(s, d, "fx_entities"), frame(s, d, "fx_rels"), W.lineage_edges(flows, steps), flagged)


_KIND = "CASE kind WHEN 'one_to_many' THEN 'HAS_MANY' WHEN 'many_to_many' THEN 'HAS_MANY' WHEN 'many_to_one' THEN 'BELONGS_TO' WHEN 'one_to_one' THEN 'BELONGS_TO' WHEN 'embeds_value_object' THEN 'OWNS' WHEN 'owns_many' THEN 'OWNS' ELSE 'REFERENCES' END"
_GRAPH = f"""{cte('fx_calls', 'fx_asks', 'fx_entities', 'fx_fields', 'fx_rels', 'fx_screens', 'fx_dtos')}, {_STEPS},
  known AS (SELECT entity AS node FROM fx_entities UNION SELECT source FROM fx_rels UNION SELECT target FROM fx_rels),
  ep AS (SELECT 'EP:' || coalesce(method, 'GET') || ':' || coalesce(path, '/?') AS node, repos FROM fx_calls),
  er AS (SELECT node AS src, regexp_extract(unnest({_LIST.format(c='repos')}), '<(\\w+)>', 1) AS x FROM ep), hr AS (SELECT 'HDL:' || cls AS src, regexp_extract(unnest({_LIST.format(c='repos')}), '<(\\w+)>', 1) AS x FROM fx_asks),
  pr AS (SELECT 'PAGE:' || cls || ':' || method AS src, unnest({_LIST.format(c='entities')}) AS x FROM fx_screens),
  w AS (SELECT s.flow_id, s.pos, f.confidence, CASE s.layer WHEN 'entity' THEN component WHEN 'api' THEN 'EP:' || component WHEN 'mediatr_handler' THEN 'HDL:' || component WHEN 'repository' THEN 'REPO:' || component END AS src FROM steps s JOIN flows f USING (flow_id) WHERE NOT has_gaps),
  l AS (SELECT *, lead(src) OVER (PARTITION BY flow_id ORDER BY pos) AS dst FROM w),
  r AS (SELECT source AS src, target AS dst, {_KIND} AS edge, via, confidence, CAST(NULL AS VARCHAR) AS flow, 0 AS a, pos AS b, via AS c FROM fx_rels
    UNION ALL SELECT src, 'REPO:' || x, 'QUERIES_VIA', NULL, 'HIGH', NULL, 1, 0, '' FROM er WHERE x <> '' UNION ALL SELECT src, x, 'SERVED_BY', NULL, 'HIGH', NULL, 2, 0, '' FROM er WHERE x IN (SELECT node FROM known)
    UNION ALL SELECT src, x, 'HANDLED_BY', NULL, 'HIGH', NULL, 3, 0, '' FROM hr WHERE x IN (SELECT node FROM known) UNION ALL SELECT src, x, 'SERVED_BY', NULL, 'HIGH', NULL, 4, 0, '' FROM pr WHERE x IN (SELECT node FROM known)
    UNION ALL SELECT src, dst, 'LINEAGE', NULL, confidence, flow_id, 5, 0, flow_id FROM l WHERE src IS NOT NULL AND dst IS NOT NULL),
  edges AS (SELECT src, dst, arg_max(edge, (a, b, c)) AS edge, arg_max(via, (a, b, c)) FILTER (via IS NOT NULL) AS via, arg_max(confidence, (a, b, c)) AS confidence, arg_max(flow, (a, b, c)) FILTER (flow IS NOT NULL) AS flow FROM r GROUP BY src, dst),
  m AS (SELECT entity AS node, CASE kind WHEN 'value_object' THEN 'value_object' ELSE 'entity' END AS node_type, CASE kind WHEN 'value_object' THEN 3 ELSE 2 END AS o FROM fx_entities UNION ALL SELECT source, 'entity', 1 FROM fx_rels UNION ALL SELECT target, 'entity', 1 FROM fx_rels
    UNION ALL SELECT node, 'api_endpoint', 3 FROM ep UNION ALL SELECT 'REPO:' || x, 'repository', 3 FROM er WHERE x <> '' UNION ALL SELECT 'HDL:' || cls, 'mediatr_handler', 3 FROM fx_asks UNION ALL SELECT 'PAGE:' || cls || ':' || method, 'page_handler', 3 FROM fx_screens
    UNION ALL SELECT 'DTO:' || dto, 'dto', 3 FROM fx_dtos UNION ALL SELECT src, '', 0 FROM edges UNION ALL SELECT dst, '', 0 FROM edges)"""
add("G04_enterprise_edges", lambda s, d: graph(s, d)[1], f"{_GRAPH} SELECT * FROM edges")
add("G04_enterprise_nodes", lambda s, d: graph(s, d)[0], f"{_GRAPH} SELECT node, nullif(arg_max(node_type, o), '') AS node_type, (SELECT count(*) FROM fx_fields f WHERE pii = 'high' AND f.entity = m.node) AS n_flags FROM m GROUP BY node")
