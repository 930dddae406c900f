"""Steps whose cost must not grow faster than their input: plans, pieces and files of bounded size."""

import pyarrow as pa
import pytest

from metaloom.operators import code as C
from metaloom.operators import ddl as D
from metaloom.operators.batches import BYTES, ROWS, pieces


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark):
    script = "CREATE PROCEDURE a.P @id int AS RETURN 1\nGO\nCREATE PROCEDURE b.P @no int, @x int AS RETURN 1\nGO\n"
    return spark.createDataFrame([("f", script)], "source_file string, text string")


def test_parameters_need_no_join_and_do_not_mix_schemas(texts):
    rows = D.parameters(D.procedures(texts))
    assert "Join" not in plan(rows)
    assert sorted((r["schema"], r["proc"], r["name"]) for r in rows.collect()) == [("a", "P", "@id"), ("b", "P", "@no"), ("b", "P", "@x")]


def test_parameters_of_any_length_and_none_of_the_body(spark):
    many = [f"@p{k} varchar({k + 1}) = 'a AS b, ('" if k % 2 else f"@p{k} int OUTPUT" for k in range(3000)]
    plain = ", ".join(f"IN q{k} decimal(9,{k})" for k in range(3000))
    inside = "AS BEGIN DECLARE @no int, @neither varchar(9)\nSELECT 1 END"
    script = f"CREATE PROCEDURE a {', '.join(many)} {inside}\nGO\nCREATE PROC b ({', '.join(many)})\n{inside}\nGO\nCREATE FUNCTION c ({plain}) RETURNS int BEGIN DECLARE @no int, @x int; RETURN 1; END\nGO\n"
    script += f"CREATE PROCEDURE d {inside}\nGO\nCREATE PROCEDURE e @as int, @of AS int, @unset varchar(max) WITH RECOMPILE {inside}\nGO\nCREATE FUNCTION f (@a int) RETURNS @t TABLE (id int) {inside}\n"
    procs = D.procedures(spark.createDataFrame([("f", script)], "source_file string, text string"))
    assert max(len(r.body) for r in procs.collect()) > 60_000
    got = {}
    for r in sorted(D.parameters(procs).collect(), key=lambda r: r.pos):
        got.setdefault(r.proc, []).append((r.name, r.raw_type, r.direction, r.default_value))
    want = [(f"@p{k}", f"varchar({k + 1})", "IN", "'a AS b, ('") if k % 2 else (f"@p{k}", "int", "OUT", "") for k in range(3000)]
    assert got["a"] == want and got["b"] == want
    assert got["c"] == [(f"q{k}", f"decimal(9,{k})", "IN", "") for k in range(3000)]
    assert "d" not in got and [x[0] for x in got["f"]] == ["@a"] and got["e"][0] == ("@as", "int", "IN", "")


def test_pieces_are_small_and_whole():
    long = "x" * (BYTES + 1)
    texts = ["a"] * (2 * ROWS + 3) + [None, long, long, "b"]
    got = list(pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])])))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert max(b.num_rows for b in got) <= ROWS and sum(long in b.column("text").to_pylist() and b.num_rows == 1 for b in got) >= 1


def test_script_files_hold_few_scripts(spark, tmp_path, monkeypatch):
    import os

    from metaloom.plans import ddl

    spark.range(3 * ddl.SCRIPTS).selectExpr("id AS p_partkey", "CAST(id % 50 AS int) AS p_size", "'b' AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = f"{tmp_path}/scripts"
    monkeypatch.setattr(ddl, "new_dir", lambda s, what: out)
    rows = {r["schema"]: (r["n_columns"], r["n_tables"]) for r in ddl.script_files(spark, str(tmp_path)).collect()}
    n, fifth = 3 * ddl.SCRIPTS, sum(k % 50 % 5 == 0 for k in range(3 * ddl.SCRIPTS))
    assert rows == {"dbo": (5 * n, n), "shop": (3 * n + 2 * fifth, n + fifth)}
    assert max(os.path.getsize(f"{out}/{f}") for f in os.listdir(out)) < ddl.SCRIPTS * 4000


def test_types_of_files_carry_what_their_file_says(spark):
    files = spark.createDataFrame([("a.cs", "namespace A.B;\nclass X : Base { }\nclass Y { }"), ("a.cs", "// ValueObject\nrecord Z(int A);"), ("b.cs", None)], "path string, text string")
    rows = C.classes(files)
    assert "Join" not in plan(rows)
    assert sorted((r["ns"], r["name"], r["is_value"]) for r in rows.collect()) == [("", "Z", True), ("A.B", "X", False), ("A.B", "Y", False)]
    java = spark.createDataFrame([("A.java", "package p.q;\n@Entity class A extends B { private int x; }"), ("A.java", "@Entity class C { }")], "path string, text string")
    found = C.jpa_entities(java)
    assert "Join" not in plan(found)
    assert sorted((r["package"], r["entity"]) for r in found.collect()) == [("", "C"), ("p.q", "A")]


def test_made_files_are_dealt_and_known_to_be_large(spark):
    from metaloom.plans import code

    for made in (code.files, code.java_files):
        df = made(spark, "/root/testdata/sf0.01")
        assert df.rdd.getNumPartitions() > 4
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        assert size > 10 << 20


def test_a_file_tells_its_relations_without_a_shuffle(spark):
    lines = ["class C : IEntityTypeConfiguration<A> { }", "b.HasMany(o => o.Xs)", *[""] * 5, ".WithMany();", "b.HasMany(o => o.Ys)", *[""] * 4, ".WithMany();", "b.OwnsOne(o => o.Z);"]
    files = spark.createDataFrame([("a.cs", "\n".join(lines)), ("a.cs", "b.HasOne(o => o.W);"), ("b.cs", "class D { }"), ("c.cs", None)], "path string, text string")
    rows = C.configured(files)
    assert "Exchange" not in plan(rows)
    found = sorted((r["source"], r["line_no"], r["via"], r["kind"]) for r in rows.collect())
    assert found == [("", 1, "W", "one_to_one"), ("A", 2, "Xs", "one_to_many"), ("A", 9, "Ys", "many_to_many"), ("A", 15, "Z", "owns_one")]


@pytest.mark.parametrize("name", ["D01_guarded_roots", "D03_invariants_of_code", "G14_code_flows", "G18_resolved_names", "G21_code_relations"])
def test_types_of_files_are_read_once(spark, monkeypatch, name):
    from metaloom import plans
    from metaloom.operators import scopes

    calls, real = [], scopes.types
    monkeypatch.setattr(scopes, "types", lambda *a, **k: calls.append(1) or real(*a, **k))
    plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_clones_of_equal_sets_are_not_compared(spark, monkeypatch):
    """All pairs, by brute force, of sets cut into several items and blocks, with names in both orders; items meet, not owners."""
    import random

    from metaloom.operators import redundancy as R

    monkeypatch.setattr(R, "ITEM", 2)
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "PARTS", 2)
    rng = random.Random(5)
    kinds = [sorted(rng.sample("abcdefgh", rng.randint(1, 8))) for _ in range(6)] + [list("abcdefg"), list("abcdefgh"), list("bcdefgh")]
    sets = {f"{rng.randint(0, 10**6):06d}": rng.choice(kinds) for _ in range(60)}
    members = spark.createDataFrame([(o, f) for o, s in sets.items() for f in s] + [("n", None), (None, "a")], "owner string, feature string")
    want = {}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and min(len(x), len(y)) >= 2 and len(x & y) / len(x | y) >= 0.7 - 1e-12:
                want[a, b] = (len(x & y), len(x | y), ",".join(sorted(x & y)), ",".join(sorted(x - y)), ",".join(sorted(y - x)))
    got = R.clones(members).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.common, r.total) for r in got} == {k: v[:2] for k, v in want.items()}
    found = R.clone_findings(members).collect()
    assert len(found) == len(want) and {(r.a, r.b): (r.shared, r.unique_a, r.unique_b) for r in found} == {k: v[2:] for k, v in want.items()}
    monkeypatch.undo()
    equal = spark.range(2000).selectExpr("id AS owner", "explode(array(1, 2, 3)) AS feature")
    assert R._alike(equal, 0.7, 2).count() < 3000 and R.clones(equal).count() == 2000 * 1999 // 2


@pytest.mark.parametrize("limit", [64, 3, 0])
def test_clones_that_differ_in_rare_features_only_are_compared_once(spark, monkeypatch, limit):
    """All pairs, by brute force, of sets with features that one owner, a few or many have; sets that differ in rare ones only
    meet as items of many owners; no table of the operator that grows goes through the driver."""
    import random

    from metaloom.operators import redundancy as R

    monkeypatch.setattr(R, "RARE", limit)
    rng = random.Random(limit)
    sets = {}
    for k in range(70):
        base = rng.choice(["abcdef", "abcd", "gh", "acegh"])
        some = {f for f in base if rng.random() < 0.9} | {f"r{k % 20}" for _ in range(rng.random() < 0.5)} | {f"u{k}" for _ in range(rng.random() < 0.3)} | {f"s{k % 6}" for _ in range(rng.random() < 0.3)}
        sets[f"{rng.randint(0, 10**6):06d}"] = some
    members = spark.createDataFrame([(o, f) for o, s in sets.items() for f in s], "owner string, feature string")
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and min(len(x), len(y)) >= 2 and len(x & y) / len(x | y) >= 0.7 - 1e-12:
                want[a, b] = (len(x & y), len(x | y), ",".join(sorted(x & y)), ",".join(sorted(x - y)), ",".join(sorted(y - x)))
    got = R.clones(members).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.common, r.total) for r in got} == {k: v[:2] for k, v in want.items()}
    found = R.clone_findings(members).collect()
    assert len(found) == len(want) and {(r.a, r.b): (r.shared, r.unique_a, r.unique_b) for r in found} == {k: v[2:] for k, v in want.items()}


def test_sets_with_a_feature_of_their_own_meet_as_few_items(spark, monkeypatch):
    from metaloom.operators import redundancy as R

    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(plan(df)) or cut(df))
    members = spark.range(2000).selectExpr("id AS owner", "explode(array('a', 'b', 'c', 'd', 'e', 'f', concat('own', id))) AS feature")
    alike = R._alike(members, 0.7, 2)
    assert alike.count() < 3000 and R.clones(members).count() == 2000 * 1999 // 2
    assert not any("Broadcast" in p for p in [plan(alike), *plans])


def test_leaves_make_no_pairs_of_ancestors(spark, monkeypatch):
    import random

    from metaloom.operators import paths

    seen, real = [], paths.distances
    monkeypatch.setattr(paths, "distances", lambda e, *a: seen.append(e.count()) or real(e, *a))
    fan = [(f"t{i}", "hub") for i in range(30)] + [("hub", f"e{i}") for i in range(30)] + [("t0", "hub"), ("u", "v")]
    rng = random.Random(11)
    mixed = [(f"n{rng.randint(0, 15)}", f"n{rng.randint(0, 15)}") for _ in range(22)]
    for edges in (fan, mixed, [*mixed, ("x", "n1"), ("n2", "y"), ("n3", "y"), ("x", "y")]):
        nodes = {x for e in edges for x in e}
        above = {n: {a for a, b in edges if b == n} for n in nodes}
        for _ in nodes:
            above = {n: above[n].union(*(above[a] for a in above[n])) for n in nodes}
        want = {n: len(a - {n}) for n, a in above.items() if a - {n}}
        assert {r.node: r.n_ancestors for r in paths.ancestor_counts(spark.createDataFrame(edges, "src string, dst string")).collect()} == want
    assert seen[0] == 0


def test_components_deal_small_blocks_and_broadcast_no_graph(spark, monkeypatch):
    """Rings, trees and one part beyond the limit, against brute force: only that part makes a pass, and no join that grows
    with the graph is a broadcast."""
    import random

    from metaloom.operators import paths

    plans, cut = [], paths.cut
    monkeypatch.setattr(paths, "LOCAL_EDGES", 12)
    monkeypatch.setattr(paths, "cut", lambda df: plans.append(plan(df)) or cut(df))
    rng = random.Random(3)
    small = [(f"r{k}_{i}", f"r{k}_{(i + 1) % (k % 5 + 2)}") for k in range(40) for i in range(k % 5 + 2)]
    small += [(f"t{k}_{i}", f"t{k}_{i // 2}") for k in range(9) for i in range(9)] + [(None, "r0_0"), ("r0_0", None), ("z", "z"), ("r1_0", "r1_0")]
    large = [(f"b{i}", f"b{i + 1}") for i in range(20)] + [(f"b{rng.randrange(21)}", f"b{rng.randrange(21)}") for _ in range(9)]
    for pairs in (small, small + large):
        rounds: list[int] = []
        got = {r.node: r.component for r in paths.components(spark.createDataFrame(pairs, "src string, dst string"), rounds).collect()}
        real = [p for p in pairs if None not in p]
        above = {n: {b for a, b in real if a == n} for p in real for n in p}
        for _ in range(8):
            above = {n: x.union(*(above[b] for b in x)) for n, x in above.items()}
        assert got == {n: min(b for b in x if n in above[b]) for n, x in above.items() if n in x}
        assert bool(rounds) == (pairs is not small)
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("[block#" in line for line in joins) and any("SortMergeJoin" in p for p in plans)


def test_blocks_are_weak_parts_in_few_rounds(spark):
    from metaloom.operators import paths

    pairs = [(a, b) if a % 3 else (b, a) for a, b in ((k, k + 1) for k in range(500))] + [(1000, 1001), (1002, 1001)] + [(2000, 2000 + k) for k in range(1, 300)]
    rounds: list[int] = []
    rows = paths._blocks(spark.createDataFrame(pairs, "src long, dst long"), rounds).collect()
    assert sorted((r.src, r.dst) for r in rows) == sorted(pairs)
    assert len({r.block for r in rows}) == len({(r.src // 1000, r.block) for r in rows}) == 3
    assert len(rounds) < 30 and rounds == sorted(rounds, reverse=True)


def test_lineage_edges_broadcast_no_tables(spark):
    from metaloom.operators import lineage as L
    from metaloom.sources.scratch import cut

    made = lambda rows, names: cut(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())))
    rows = L.edges(made([("T",)], "tbl"), made([("V", "T"), ("W", "V"), ("W", "gone")], "view source"), made([("P", "T", "", "")], "proc reads writes deletes"), made([("T", "U", "a")], "tbl ref_tbl cols"))
    assert "BroadcastHashJoin" not in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [("T", "PROC:P", "proc_reads", "P"), ("T", "U", "fk_reference", "a"), ("T", "VIEW:V", "view_reads", "V"), ("VIEW:V", "VIEW:W", "view_reads_view", "W")]
