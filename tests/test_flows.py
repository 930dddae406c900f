"""The flow trace against a plain walk; nulls, ties, repeated rows, empty tables and further columns."""

import random
import re

from metaloom.operators import flows as W

ENDS = "method string, path string, cls string, auth boolean, request string, response string, services array<string>, repos array<string>, file string, flow_key int"
HANDS = "cls string, request string, response string, repos array<string>, file string, times string"
ENTS, FIELDS = "entity string, kind string, file string, kept boolean", "entity string, pos int, field string, type string, is_nav boolean"


def walk(ends, hands, ents, fields):
    """(kind, flow) -> layers and components, has_gaps, confidence, boundaries, times."""
    known = {e[0] for e in ents if e[0] and e[1] != "value_object"}
    values = {e[0] for e in ents if e[0] and e[1] == "value_object"}
    out, covered = {}, set()
    for head in [*ends, *hands]:
        rest = len(head) == len(ends[0]) if ends else False
        services, repos = (head[6], head[7]) if rest else ([], head[3])
        steps = [("api", f"{head[0] or '?'} {head[1] or '?'}")] if rest else [("mediatr_handler", head[0] or "?")]
        steps += [("dto", head[4])] if rest and head[4] else []
        steps += [("service", x) for x in services or [] if x]
        for r in repos or []:
            steps += [("repository", r)] if r else []
            m = re.search(r"<(\w+)>", r or "")
            if m and m[1] in known:
                steps.append(("entity", m[1]))
                held = sorted({(f[1], f[2], f[3].rstrip("?")) for f in fields if f[0] == m[1] and f[4] and f[3] and "<" not in f[3] and f[3].rstrip("?") in values}) if rest else []
                steps += [("value_object", h[2]) for h in held]
        steps += [("dto", head[5])] if rest and head[5] else []
        entities = {c for layer, c in steps if layer == "entity"}
        covered |= entities
        if rest:
            level = "MEDIUM" if any(layer == "service" for layer, _ in steps) else "HIGH"
            limits = [n for n, on in (("authentication", head[3]), ("cross_entity", len(entities) > 1), ("dto_transformation", head[4] and entities)) if on]
        else:
            level, limits = ("HIGH" if entities else "MEDIUM"), []
        key = ("rest_api" if rest else "mediatr_handler", repr(head))
        times = out[key][-1] + 1 if key in out else 1
        out[key] = (steps, not entities, level, limits, times)
    for e in known - covered:
        out[("gap", e)] = ([("entity", e)], True, "MEDIUM", [], 1)
    return sorted((k[0], *map(repr, v)) for k, v in out.items())


def found(spark, ends, hands, ents, fields):
    make = spark.createDataFrame
    flows, steps = W.trace(make(ends, ENDS), make(hands, HANDS), make(ents, ENTS), make(fields, FIELDS))
    listed = {}
    for r in sorted(steps.collect(), key=lambda r: r.pos):
        listed.setdefault(r.flow_key, []).append((r.layer, r.component))
    rows = flows.collect()
    assert all(r.n_steps == len(listed[r.flow_key]) for r in rows) and len(listed) == len(rows)
    total = W.totals(flows).first()
    assert total.flow_count == sum(r.times for r in rows) == total.complete_flows + total.gap_flows
    return sorted((r.kind, *map(repr, (listed[r.flow_key], r.has_gaps, r.confidence, r.boundaries, r.times))) for r in rows)


def test_trace_equals_a_plain_walk(spark):
    rng = random.Random(11)
    some = lambda *xs: rng.choice(xs)
    repo = lambda: some("IRepository<A>", "IReadRepository<B>", "IRepository<V>", "Plain", "", None)
    ends = [(some("GET", None), some("/a", "/b/{id}", None), "C", some(True, False, None), some("Q", "", None), some("R", None), some([], ["S", "T"], None, [None]), some(None, [repo() for _ in range(rng.randrange(4))]), "f", 1) for _ in range(40)]
    ends += [(None,) * 10] * 2
    hands = [(some("H", None), some("Ask", None), "int", some(None, [repo(), repo()]), None, "x") for _ in range(15)]
    ents = [("A", "entity", "1", True), ("A", "entity", "2", True), ("B", "aggregate_root", None, None), ("V", "value_object", "v", None), ("W", "value_object", "v", None), ("Lost", None, "l", None), (None, "entity", "n", None)]
    fields = [("A", 0, "v", "V?", True), ("A", 1, "w", "W", True), ("A", 2, "v", "List<V>", True), ("A", 3, "n", None, True), ("B", 0, "v", "V", None), (None, 0, "x", "V", True), ("A", 1, "w", "W", True)]
    assert found(spark, ends, hands, ents, fields) == walk(ends, hands, ents, fields)


def test_trace_of_empty_tables(spark):
    assert found(spark, [], [], [], []) == []
    assert found(spark, [], [], [("A", "entity", "f", None)], []) == [("gap", "[('entity', 'A')]", "True", "'MEDIUM'", "[]", "1")]


def test_graph_makes_missing_nodes_and_keeps_the_last_edge(spark):
    make = spark.createDataFrame
    ends = make([("GET", "/a", "C", None, None, None, [], ["IRepository<A>", None], "f", 1)] * 2, ENDS)
    hands, ents = make([("A", "Ask", "", ["R<A>"], "f", "")], HANDS), make([("A", "entity", "f", None), (None, None, None, None)], ENTS)
    pages = make([("P", "GET", ["A", "Nowhere"]), ("P", "POST", None)], "cls string, method string, entities array<string>")
    dtos, findings = make([("D",), (None,)], "dto string"), make([("A",), ("A",), (None,)], "entity string")
    rels = make([("A", "B", "one_to_many", "bs", "HIGH", 0), ("A", "B", "odd", None, None, 1), (None, "B", "references", "x", "LOW", 2)], "source string, target string, kind string, via string, confidence string, pos int")
    lineage = W.lineage_edges(*W.trace(ends, hands, ents, make([], FIELDS)))
    nodes, edges = W.enterprise_graph(ends, hands, pages, dtos, ents, rels, lineage, findings)
    assert {r.node: (r.node_type, r.n_flags) for r in nodes.collect()} == {
        "A": ("entity", 2), "B": ("entity", 0), "EP:GET:/a": ("api_endpoint", 0), "REPO:A": ("repository", 0), "HDL:A": ("mediatr_handler", 0), "PAGE:P:GET": ("page_handler", 0), "PAGE:P:POST": ("page_handler", 0), "DTO:D": ("dto", 0),
        "EP:GET /a": (None, 0), "REPO:IRepository<A>": (None, 0), "REPO:R<A>": (None, 0),
    }
    assert {(r.src, r.dst): (r.edge, r.via, r.confidence) for r in edges.collect()} == {
        ("A", "B"): ("REFERENCES", "bs", "MEDIUM"), ("EP:GET:/a", "REPO:A"): ("QUERIES_VIA", None, "HIGH"), ("EP:GET:/a", "A"): ("SERVED_BY", None, "HIGH"), ("HDL:A", "A"): ("HANDLED_BY", None, "HIGH"), ("PAGE:P:GET", "A"): ("SERVED_BY", None, "HIGH"),
        ("EP:GET /a", "REPO:IRepository<A>"): ("LINEAGE", None, "HIGH"), ("REPO:IRepository<A>", "A"): ("LINEAGE", None, "HIGH"), ("HDL:A", "REPO:R<A>"): ("LINEAGE", None, "HIGH"), ("REPO:R<A>", "A"): ("LINEAGE", None, "HIGH"),
    }
