"""Orders, subsets and guards on nulls, ties, empty tables and further columns."""

from metaloom.operators import aggregates as A


def test_orders_put_unknown_levels_last_and_keep_every_row(spark):
    rows = [(s, c, i) for i, (s, c) in enumerate([("NOTE", "LOW"), ("CRITICAL", None), (None, "HIGH"), ("WARNING", "odd"), ("CRITICAL", "HIGH"), ("odd", "MEDIUM")] * 50)]
    df = spark.createDataFrame(rows, "severity string, confidence string, id int")
    rank = lambda order, v: order.index(v) if v in order else 3
    got = {r.place: r.id for r in A.by_severity(df, ["id"]).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in sorted(rows, key=lambda r: (rank(A.SEVERITIES, r[0]), r[2]))]
    got = {r.place: r.id for r in A.by_confidence(df, ["id"]).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in sorted(rows, key=lambda r: (rank(A.CONFIDENCES, r[1]), r[2]))]
    assert A.by_severity(df.limit(0), ["id"]).collect() == []


def test_counts_and_subsets(spark):
    df = spark.createDataFrame([("a", "pci_dss", "financial", None), ("a", "pci_dss", "financial", None), ("b", "pii", None, "NOTE"), ("c", "pci_dss", "", "NOTE")], "entity string, rule string, category string, severity string")
    assert {r.value: r.n for r in A.count_by(df, "severity").collect()} == {"unknown": 2, "NOTE": 2}
    assert sorted((r.subset, r.entity) for r in A.subsets(df).collect()) == [("gdpr", "a"), ("gdpr", "a"), ("pci", "a"), ("pci", "a"), ("pci", "c")]


def test_guards_of_roots(spark):
    ents = spark.createDataFrame([("A", True, 1), ("A", True, 2), ("B", True, 3), ("C", None, 4), (None, True, 5)], "entity string, is_root boolean, param int")
    props = spark.createDataFrame([("A", "xs", "public", "collection"), ("A", "ys", "none", "collection"), ("A", "zs", "private", "collection"), ("B", "n", "private", "primitive"), ("B", "n", "private", "primitive"), (None, None, None, None)], "entity string, name string, setter string, category string")
    params = spark.createDataFrame([("B", "n"), ("B", "n"), ("C", "m"), ("D", "k")], "entity string, param string")
    assert sorted(map(tuple, A.guarded_roots(ents.dropna(subset=["entity"]), props, params).collect())) == [("A", "xs,ys", True, False), ("B", "", False, True)]
    assert sorted(map(tuple, A.invariants_of(ents, props, params).collect())) == [("B", "constructor_guard", "n"), ("B", "private_setter_invariant", "n"), ("C", "constructor_guard", "m")]
    assert A.guarded_roots(ents.limit(0), props, params).collect() == []


def test_profiles_ignore_comments_and_text(spark):
    text = 'class P : Profile { P() { CreateMap<A, B>(); /* CreateMap<C, D>() */ var s = "CreateMap<E, F>"; CreateMap < A , B > (); CreateMap<B,A>(); } }\nclass Q { }'
    files = spark.createDataFrame([("a.cs", text), ("b.cs", None), ("c.java", text)], "path string, text string")
    assert [tuple(r) for r in A.mapper_profiles(files).collect()] == [("a.cs", "P", "A>B,B>A")]
