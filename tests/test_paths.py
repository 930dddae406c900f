"""Graph operators on graphs that the queries do not hold: against brute force, with counts of what rounds make."""

import random

import pytest

from metaloom.operators import catalog_graph, ddl, paths, ranks
from pyspark.sql import functions as F

EDGES = "src string, dst string, kind string, pos int"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "read", i) for i, (a, b) in enumerate(pairs)], EDGES)


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    out = {x: {b for a, b in pairs if a == x} for x in nodes}
    reach = {}
    for x in nodes:
        seen, front = set(), set(out[x])
        while front:
            seen |= front
            front = {y for f in front for y in out[f]} - seen
        reach[x] = seen
    return {x: min({y for y in reach[x] if x in reach[y]} | {x}) for x in nodes if x in reach[x]}, reach


@pytest.mark.parametrize("local", [0, paths.LOCAL_EDGES])
def test_components_equal_brute_force(spark, local, monkeypatch):
    monkeypatch.setattr(paths, "LOCAL_EDGES", local)
    rng = random.Random(local)
    for n, m in ((12, 16), (30, 36)):
        pairs = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        want, reach = brute_components(pairs)
        assert {r.node: r.component for r in paths.components(frame(spark, pairs)).collect()} == want
    counts = {r.node: r.n_ancestors for r in paths.ancestor_counts(frame(spark, pairs)).collect()}
    above = {x: sum(x in reach[y] for y in reach if y != x) for x in reach}
    assert counts == {x: k for x, k in above.items() if k}


def test_an_acyclic_part_makes_no_pass(spark, monkeypatch):
    monkeypatch.setattr(paths, "LOCAL_EDGES", 0)
    tree = [(f"t{k:03d}", f"t{(k - 1) // 3:03d}") for k in range(1, 300)]
    rounds = []
    assert paths.components(frame(spark, tree), rounds).count() == 0 and rounds == []
    ring = [(f"r{k}", f"r{(k + 1) % 4}") for k in range(4)]
    got = paths.components(frame(spark, [*tree, *ring, ("t299", "r0"), ("r1", "t000")]), rounds)
    assert {r.node for r in got.collect()} == {f"r{k}" for k in range(4)} and rounds == [4]
    assert paths.cycles(frame(spark, tree), sizes := []).count() == 0 and sizes == [0]


def test_distances_of_a_long_chain_take_log_rounds(spark):
    n, rounds = 1000, []
    got = paths.distances(frame(spark, [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(n)]), rounds)
    assert got.count() == n * (n + 1) // 2 and len(rounds) == 11
    assert got.where(F.substring("dst", 2, 4).cast("int") - F.substring("src", 2, 4).cast("int") != F.col("distance")).count() == 0


def test_chains_do_not_enter_dead_ends_of_a_hub(spark):
    pairs = [("a", "hub")]
    for k in range(500):
        pairs += [("hub", f"x{k:03d}"), (f"x{k:03d}", "hub")]
    pairs += [("hub", "p"), ("p", "q"), ("q", "end")]
    sizes = []
    got = paths.chains(frame(spark, pairs), starts=1, sizes=sizes)
    assert [r.path for r in got.collect()] == ["a→hub→p→q→end"]
    assert sizes == [1, 1, 1, 1, 0]


def test_chains_of_parallel_edges_and_self_loops(spark):
    rows = [("a", "b", "read", 0), ("a", "b", "write", 1), ("b", "b", "fk", 2), ("a", "c", "read", 3), ("c", "c", "fk", 4), ("a", "d", "read", 5)]
    got = paths.chains(spark.createDataFrame(rows, EDGES)).collect()
    assert [(r.path, r.kinds, r.has_write, r.risk) for r in got] == [("a→d", "read", False, "LOW")]
    assert paths.chains(spark.createDataFrame([], EDGES)).count() == 0


def test_graphs_with_nulls_repeats_and_nothing(spark):
    rows = [("a", "b", "fk", 0), ("b", "a", "fk", 1), ("a", "b", "fk", 2), (None, "a", "fk", 3), ("b", None, "fk", 4)]
    df = spark.createDataFrame(rows, EDGES)
    assert {(r.node, r.component) for r in paths.components(df).collect()} == {("a", "a"), ("b", "a")}
    assert [r.cycle for r in paths.cycles(df).collect()] == ["a→b"]
    empty = spark.createDataFrame([], EDGES)
    assert paths.components(empty).count() == paths.distances(empty).count() == paths.cycles(empty).count() == 0


def test_running_sums_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 3, 70])) for k in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r.k: (r.total, r.n) for r in ranks.running_sums(df, [F.desc("k")], total=F.col("v"), n=F.lit(1)).collect()}
    total, n = 0, 0
    for k, v in sorted(rows, reverse=True):
        total, n = total + (v or 0), n + 1
        assert got[k] == (total, n)
    assert ranks.running_sums(df.limit(0), [F.col("k")], total=F.col("v")).count() == 0
    assert sorted(r.id for r in ranks.numbered(df, [F.col("k")]).collect()) == list(range(2000))


def test_first_rows_of_a_group_are_merged(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), "id").repartition(9)
    got = sorted((r.g, r.id) for r in ranks.first_per_group(df, ["g"], ["id"], 4).collect())
    assert got == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 1), ("b", 2), ("b", 4), ("b", 5)]


SCRIPT = """/* CREATE TABLE Gone (x int)
 */ INSERT INTO log VALUES ('CREATE TABLE Ghost (a int)') -- CREATE TABLE Also (b int)
CREATE TABLE [a(b].[T 1] ([Id] int, note varchar(10) DEFAULT 'a,(b', CONSTRAINT pk PRIMARY KEY CLUSTERED ([Id] ASC, note DESC))
GO
CREATE TABLE Other (Code int)
CREATE INDEX ix ON Other (Code DESC)
it's [open
"""


def test_statements_mask_what_is_quoted(spark):
    texts = spark.createDataFrame([("f", SCRIPT), ("g", None), ("h", ""), ("i", "[" * 50_000 + "'" * 50_001), ("j", "CREATE TABLE Other (Code int)")], "source_file string, text string")
    found = ddl.statements(texts)
    got = [(r.schema, r.tbl, r.line, r.kind, r.constraint, r.clause) for r in found.orderBy("line", "pos").where("source_file = 'f'").collect()]
    assert [g[:5] for g in got] == [("a(b", "T 1", 3, "column", ""), ("a(b", "T 1", 3, "column", ""), ("a(b", "T 1", 3, "pk", "pk"), ("dbo", "Other", 5, "column", ""), ("dbo", "Other", 6, "statement", "ix")]
    assert [r.cols for r in ddl.constraints(found).collect()] == ["Id,note"]
    columns = {(r.source_file, r.tbl, r.name): (r.is_pk, r.is_indexed, r.default_value) for r in ddl.columns(found, ddl.indexes(found)).collect()}
    assert columns == {("f", "T 1", "Id"): (True, True, ""), ("f", "T 1", "note"): (True, True, "'a,(b'"), ("f", "Other", "Code"): (False, True, ""), ("j", "Other", "Code"): (False, False, "")}


def test_a_property_graph_has_both_ends_of_each_edge(spark):
    text = "CREATE TABLE A (id int PRIMARY KEY, b int REFERENCES B(id))\nGO\nCREATE PROC p AS DELETE FROM C EXEC q\n"
    nodes, edges = catalog_graph.property_graph(ddl.statements(spark.createDataFrame([("f", text), ("g", text)], "source_file string, text string")))
    ids = {r.id: r for r in nodes.collect()}
    assert sorted(ids) == list(range(len(ids)))
    assert {r.key for r in ids.values() if r.dangling} == {"TABLE:B", "COLUMN:B.id", "TABLE:C", "PROCEDURE:q"}
    got = {(ids[r.src_id].key, r.edge, ids[r.dst_id].key) for r in edges.collect()}
    assert {("TABLE:A", "FK_TO", "TABLE:B"), ("COLUMN:A.b", "REFERENCES", "COLUMN:B.id"), ("PROCEDURE:p", "PROC_DELETES", "TABLE:C"), ("PROCEDURE:p", "PROC_CALLS", "PROCEDURE:q"), ("TABLE:A", "HAS_CONSTRAINT", "CONSTRAINT:PK_A")} <= got
