"""Flows from endpoints and handlers down to value objects, and the enterprise graph that they are part of.

trace() writes the steps that a head (an endpoint or a handler) names itself as one array a row, so that only repository
steps are joined to entities, and entity steps to the value objects that they hold. A flow's steps are as many as its head
names: the window that numbers them never sees more. Equal heads are one flow with their number in `times`.

    endpoints: method, path, cls, auth, request, response, services, repos, file    (services, repos: arrays of names)
    handlers: cls, request, response, repos, file                                   (a repository is like IRepository<Order>)
    entities: entity, kind, file                 fields: entity, pos, field, type, is_nav

Null and empty names make no step, a null method or path is "?", null arrays are empty. Of entities that share a name, the one
of the last file counts. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.scalar import confidence_rank
from metaloom.operators.catalog import flow_id
from metaloom.sources.scratch import cut

#: What a relationship's kind is called as an edge.
EDGE_OF_KIND = {"one_to_many": "HAS_MANY", "many_to_one": "BELONGS_TO", "many_to_many": "HAS_MANY", "embeds_value_object": "OWNS", "owns_many": "OWNS", "one_to_one": "BELONGS_TO", "references": "REFERENCES"}
STEP = "struct<stage: int, at: int, layer: string, component: string, direction: string, confidence: string>"
HEAD = ("kind", "flow_id", "flow", "auth", "file")


def _step(stage: int, at: Column, layer: str, component: Column, confidence: str = "HIGH", direction: str | None = None) -> Column:
    return F.struct(F.lit(stage).alias("stage"), at.cast("int").alias("at"), F.lit(layer).alias("layer"), component.alias("component"), F.lit(direction).cast("string").alias("direction"), F.lit(confidence).alias("confidence"))


def _each(stage: int, names: str, layer: str, confidence: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(F.col(names), empty), lambda n, i: _step(stage, i, layer, n, confidence))


def _heads(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """The columns of HEAD, flow_key, times and the steps that a head names itself."""
    or_mark = lambda c: F.coalesce(F.col(c), F.lit("?"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    called = F.concat_ws(" ", or_mark("method"), or_mark("path"))
    ends = endpoints.select(
        F.lit("rest_api").alias("kind"), flow_id(or_mark("method"), or_mark("path")).alias("flow_id"), called.alias("flow"), F.coalesce("auth", F.lit(False)).alias("auth"), "file", "cls",
        F.concat(F.array(_step(0, zero, "api", called), _step(1, zero, "dto", F.col("request"), direction="inbound")), _each(2, "services", "service", "MEDIUM"), _each(3, "repos", "repository", "HIGH"), F.array(_step(4, zero, "dto", F.col("response"), direction="outbound"))).cast(f"array<{STEP}>").alias("named"),
    )
    hands = handlers.select(
        F.lit("mediatr_handler").alias("kind"), F.concat(F.lit("handler_"), F.coalesce("cls", F.lit(""))).alias("flow_id"), F.concat(F.lit("MediatR: "), F.coalesce("request", F.lit("Unknown"))).alias("flow"), F.lit(False).alias("auth"), "file", "cls",
        F.concat(F.array(_step(0, zero, "mediatr_handler", or_mark("cls"))), _each(3, "repos", "repository", "HIGH")).cast(f"array<{STEP}>").alias("named"),
    )
    keyed = ends.unionByName(hands).withColumn("flow_key", F.sha2(F.to_json(F.struct(*HEAD, "cls", "named")), 256))
    same = keyed.groupBy("flow_key").agg(*[F.first(c).alias(c) for c in (*HEAD, "named")], F.count(F.lit(1)).alias("times"))
    return same.withColumn("named", F.filter("named", lambda s: F.coalesce(s["component"], F.lit("")) != ""))


def trace(endpoints: DataFrame, handlers: DataFrame, entities: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, steps).

    flows: flow_key, kind (rest_api, mediatr_handler, gap), flow_id, flow, auth, file, times, n_steps, has_gaps, confidence,
    boundaries. A flow has a gap without an entity step. An endpoint's confidence is its weakest step's, a handler's is HIGH
    without a gap, else MEDIUM. Boundaries: authentication; cross_entity (several entities); dto_transformation (a request
    model and an entity). Entities that no flow reaches are flows of kind gap.
    steps: flow_key, pos, layer, component, direction, via, owner, confidence; layers are api or mediatr_handler, dto (inbound),
    service, then each repository with its entity and, for endpoints, the value objects that this holds, dto (outbound)."""
    known = entities.where("coalesce(kind, '') <> 'value_object' AND entity <> ''").groupBy("entity").agg(F.max("file").alias("entity_file"))
    values = entities.where("kind = 'value_object' AND entity <> ''").select(F.col("entity").alias("held")).distinct()
    holds = fields.where("is_nav AND NOT contains(type, '<')").select(F.col("entity").alias("owner"), F.col("pos").alias("place"), F.col("field").alias("via"), F.regexp_replace("type", r"\?$", "").alias("held"))
    holds = holds.join(values, "held", "left_semi").distinct()
    heads = cut(_heads(endpoints, handlers))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    named = heads.select("flow_key", "kind", F.explode("named").alias("s")).select("flow_key", "kind", "s.*").withColumns({"sub": zero, "place": zero, "via": none, "owner": none})
    target = F.regexp_extract("component", r"<(\w+)>", 1)
    reached = named.where("layer = 'repository'").withColumn("entity", target).where("entity <> ''").join(known.select("entity"), "entity")
    reached = reached.withColumns({"layer": F.lit("entity"), "component": F.col("entity"), "sub": F.lit(1)}).select(*named.columns)
    held = reached.where("kind = 'rest_api'").drop("owner", "via", "place").withColumn("owner", F.col("component")).join(holds, "owner")
    held = held.withColumns({"layer": F.lit("value_object"), "component": F.col("held"), "sub": F.lit(2)}).select(*named.columns)
    every = cut(named.unionByName(reached).unionByName(held))
    in_flow = Window.partitionBy("flow_key").orderBy("stage", "at", "sub", "place", "via", "component")
    steps = every.select("flow_key", (F.row_number().over(in_flow) - 1).alias("pos"), "layer", "component", "direction", "via", "owner", "confidence")

    entity = F.when(F.col("layer") == "entity", F.col("component"))
    seen = every.groupBy("flow_key").agg(F.count(F.lit(1)).alias("n_steps"), F.min(entity).alias("first"), F.max(entity).alias("last"), F.min(confidence_rank(F.col("confidence"))).alias("least"), F.bool_or(F.col("direction").eqNullSafe("inbound")).alias("asked"))
    gap, rest = F.col("first").isNull(), F.col("kind") == "rest_api"
    level = F.when(F.col("least") == 3, "HIGH").when(F.col("least") == 2, "MEDIUM").otherwise("LOW")
    limits = F.array_compact(F.array(F.when(F.col("auth"), "authentication"), F.when(F.col("first") != F.col("last"), "cross_entity"), F.when(F.col("asked") & ~gap, "dto_transformation")))
    flows = heads.drop("named").join(seen, "flow_key").select(
        "flow_key", *HEAD, "times", "n_steps", gap.alias("has_gaps"), F.when(rest, level).when(gap, "MEDIUM").otherwise("HIGH").alias("confidence"), F.when(rest, limits).otherwise(F.array().cast("array<string>")).alias("boundaries")
    )
    missed = known.join(every.where("layer = 'entity'").select(F.col("component").alias("entity")).distinct(), "entity", "left_anti")
    missed = missed.withColumn("flow_key", F.concat(F.lit("gap_"), "entity"))
    lost = missed.select("flow_key", F.lit("gap").alias("kind"), F.col("flow_key").alias("flow_id"), F.concat(F.lit("Entity: "), "entity", F.lit(" (no direct API trace)")).alias("flow"), F.lit(False).alias("auth"), F.col("entity_file").alias("file"), F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("n_steps"), F.lit(True).alias("has_gaps"), F.lit("MEDIUM").alias("confidence"), F.array().cast("array<string>").alias("boundaries"))
    lost_steps = missed.select("flow_key", zero.alias("pos"), F.lit("entity").alias("layer"), F.col("entity").alias("component"), none.alias("direction"), none.alias("via"), none.alias("owner"), F.lit("HIGH").alias("confidence"))
    return flows.unionByName(lost), steps.unionByName(lost_steps)


def totals(flows: DataFrame) -> DataFrame:
    """One row: all flows, those without and with gaps, repeats counted."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0))
    return flows.agg(n(F.lit(True)).alias("flow_count"), n(~F.col("has_gaps")).alias("complete_flows"), n(F.col("has_gaps")).alias("gap_flows"))


def _step_node() -> Column:
    name = F.when(F.col("layer") == "entity", F.col("component"))
    for layer, mark in (("api", "EP:"), ("mediatr_handler", "HDL:"), ("repository", "REPO:")):
        name = name.when(F.col("layer") == layer, F.concat(F.lit(mark), "component"))
    return name


def lineage_edges(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(src, dst, flow, confidence) of neighbouring steps in flows without a gap; transfer objects, services and value objects
    break the line."""
    whole = steps.join(flows.where("NOT has_gaps").select("flow_key", F.col("flow_id").alias("flow"), F.col("confidence").alias("level")), "flow_key")
    nxt = whole.withColumn("src", _step_node()).withColumn("dst", F.lead("src").over(Window.partitionBy("flow_key").orderBy("pos")))
    return nxt.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "flow", F.col("level").alias("confidence"))


def enterprise_graph(endpoints: DataFrame, handlers: DataFrame, pages: DataFrame, dtos: DataFrame, entities: DataFrame, relations: DataFrame, lineage: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, node_type, n_flags; edges: src, dst, edge, via, confidence, flow).

    pages: cls, method, entities (array); dtos: dto; relations: source, target, kind, via, confidence, pos; findings: entity.
    Nodes of entities, value objects, endpoints, handlers, pages, repositories and transfer objects; an end of a relation that
    nothing defines is an entity, one of a lineage step (which has a name of its own) has no type. Of parallel edges the last
    one written counts (relations, endpoints, handlers, pages, lineage); what it does not state stays as it was."""
    none = F.lit(None).cast("string")
    known_end = lambda c: relations.select(F.col(c).alias("node")).where("node <> ''")
    known = entities.select(F.col("entity").alias("node")).where("node <> ''").union(known_end("source")).union(known_end("target")).distinct()
    end_node = F.concat(F.lit("EP:"), F.coalesce("method", F.lit("GET")), F.lit(":"), F.coalesce("path", F.lit("/?")))
    hand_node, page_node = F.concat(F.lit("HDL:"), F.coalesce("cls", F.lit("?"))), F.concat(F.lit("PAGE:"), F.coalesce("cls", F.lit("?")), F.lit(":"), F.coalesce("method", F.lit("?")))
    target = F.regexp_extract("r", r"<(\w+)>", 1)
    by_end = endpoints.select(end_node.alias("src"), F.explode("repos").alias("r")).select("src", target.alias("dst")).where("dst <> ''")
    by_hand = handlers.select(hand_node.alias("src"), F.explode("repos").alias("r")).select("src", target.alias("dst")).where("dst <> ''")
    by_page = pages.select(page_node.alias("src"), F.explode("entities").alias("dst"))
    of_known = lambda df: df.join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    kinds = F.create_map(*[F.lit(x) for pair in EDGE_OF_KIND.items() for x in pair])
    high = F.lit("HIGH")

    def edge(df: DataFrame, stage: int, name: Column, confidence: Column = high, via: Column = none, flow: Column = none, pos: Column | None = None) -> DataFrame:
        at = F.struct(F.lit(stage).alias("a"), (F.lit(0) if pos is None else pos).cast("long").alias("b"), F.coalesce(flow, via, F.lit("")).alias("c"), name.alias("d"), confidence.alias("e"))
        return df.select("src", "dst", name.alias("edge"), via.alias("via"), confidence.alias("confidence"), flow.alias("flow"), at.alias("at"))

    ends = relations.where("source <> '' AND target <> ''").withColumnsRenamed({"source": "src", "target": "dst"})
    rows = edge(ends, 0, F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("REFERENCES")), F.coalesce("confidence", F.lit("MEDIUM")), F.col("via"), pos=F.col("pos"))
    rows = rows.unionByName(edge(by_end.withColumn("dst", F.concat(F.lit("REPO:"), "dst")), 1, F.lit("QUERIES_VIA")))
    rows = rows.unionByName(edge(of_known(by_end), 2, F.lit("SERVED_BY"))).unionByName(edge(of_known(by_hand), 3, F.lit("HANDLED_BY"))).unionByName(edge(of_known(by_page), 4, F.lit("SERVED_BY")))
    rows = rows.unionByName(edge(lineage, 5, F.lit("LINEAGE"), F.col("confidence"), flow=F.col("flow")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    edges = cut(rows.groupBy("src", "dst").agg(*[last(c) for c in ("edge", "via", "confidence", "flow")]))

    def node(df: DataFrame, name: Column, stage: int, kind: str | None) -> DataFrame:
        return df.select(name.alias("node"), F.lit(kind).cast("string").alias("node_type"), F.lit(stage).alias("stage")).where("node <> ''")

    made = node(entities.where("coalesce(kind, '') <> 'value_object'"), F.col("entity"), 2, "entity").union(node(entities.where("kind = 'value_object'"), F.col("entity"), 3, "value_object"))
    made = made.union(node(known_end("source").union(known_end("target")), F.col("node"), 1, "entity"))
    made = made.union(node(endpoints, end_node, 3, "api_endpoint")).union(node(by_end, F.concat(F.lit("REPO:"), "dst"), 3, "repository"))
    made = made.union(node(handlers, hand_node, 3, "mediatr_handler")).union(node(pages, page_node, 3, "page_handler")).union(node(dtos.where("dto <> ''"), F.concat(F.lit("DTO:"), "dto"), 3, "dto"))
    made = made.union(node(edges, F.col("src"), 0, None)).union(node(edges, F.col("dst"), 0, None))
    flags = findings.where("entity <> ''").groupBy(F.col("entity").alias("node")).agg(F.count(F.lit(1)).alias("n_flags"))
    nodes = made.groupBy("node").agg(F.max_by("node_type", "stage").alias("node_type")).join(flags, "node", "left").select("node", "node_type", F.coalesce("n_flags", F.lit(0)).cast("long").alias("n_flags"))
    return nodes, edges
