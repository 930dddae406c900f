"""Every query of the metadata operators against its DuckDB SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

import metaloom.plans as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def tidy(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return tuple(map(tidy, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(name, spark, duck):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in plans.ORACLES:
        assert mine
        return
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(tidy(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_nothing_else_imports_the_training_operators():
    import subprocess
    import sys

    code = "import sys, metaloom.plans, metaloom.streaming.incremental; sys.exit(any(m.startswith('metaloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_paths_equal_brute_force(spark):
    import random

    from metaloom.operators.graph import chains, cycles, distances

    rng = random.Random(3)
    for _ in range(3):
        edges = sorted({(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(9)})
        df = spark.createDataFrame([(a, b, "read", i) for i, (a, b) in enumerate(edges)], "src string, dst string, kind string, pos int")
        out = {a: sorted(y for x, y in edges if x == a) for a in "abcdef"}
        paths, loops = [], set()

        def walk(p):
            nxt = out[p[-1]]
            if len(p) > 1 and (not nxt or len(p) == 6):
                paths.append("→".join(p))
            elif len(p) < 6:
                for y in nxt:
                    if y not in p:
                        walk([*p, y])

        def loop(p):
            for y in out[p[-1]]:
                if y == p[0]:
                    loops.add("→".join(p))
                elif y > p[0] and y not in p:
                    loop([*p, y])

        for a in sorted({x for e in edges for x in e}):
            walk([a])
            loop([a])
        assert sorted(r.path for r in chains(df).collect()) == sorted(paths)
        assert {r.cycle for r in cycles(df).collect()} == loops
        far = {}
        for a in "abcdef":
            seen, front, n = {a}, [a], 0
            while front:
                n += 1
                front = sorted({y for x in front for y in out[x]} - seen)
                seen |= set(front)
                far |= {(a, y): n for y in front}
        assert {(r.src, r.dst): r.distance for r in distances(df).collect()} == far


def test_cycles_and_call_depths_have_no_bound(spark):
    from metaloom.operators.graph import call_depths, cycles

    ring = spark.createDataFrame([(f"n{k}", f"n{(k + 1) % 9}") for k in range(9)], "src string, dst string")
    assert [(r.cycle, r.length) for r in cycles(ring).collect()] == [("→".join(f"n{k}" for k in range(9)), 9)]
    procs = spark.createDataFrame([(f"p{k}",) for k in range(36)], "proc string")
    calls = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(35)], "caller string, callee string")
    assert {r.proc: r.call_depth for r in call_depths(procs, calls).collect()} == {f"p{k}": k for k in range(36)}
