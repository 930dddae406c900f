"""Many patterns in one pass, against each pattern searched on its own."""

import random
import re

from metaloom.operators import stack as T
from metaloom.operators.signals import Scanner, literals, rule_hits

RULES = [*((n, p) for n, p, _ in T.ORMS), *T.STYLES, *((n, f"(?i){p}") for n, p in T.DIALECTS), *((n, f"(?i){p}") for p, n in (*T.FRAMEWORKS, *T.DB_PACKAGES, *T.DB_CONFIG)), *((f"{n}{i}", f"(?i){p}") for n, ps, _, xs in T.ARCHITECTURES for i, p in enumerate((*ps, *xs)))]
ODD = [("any", "."), ("digits", r"\d{3}"), ("maybe", "(?:cat)?dog|ca"), ("twice", "(?:ab|cd){2,}x"), ("set", "[kK]it"), ("start", r"^\bGO\b"), ("look", "foo(?=bar)"), ("case", "ABC"), ("empty", ""), ("none", "(?:xyz){0,2}q"), ("lazy", "a+?bcd"), ("atomic", "(?>abc)d")]


def test_literals_are_in_every_match():
    assert literals("Host=.*port=5432|postgresql") == {"port=5432", "postgresql"}
    assert literals("(?:cat)?dog") == {"dog"} and literals(r"\d{3}") is None and literals("") is None and literals("(?i)ABC|D") is None


def test_hits_equal_single_searches():
    rng = random.Random(5)
    rules = tuple(RULES + ODD)
    words = sorted({w for _, p in rules for w in literals(p) or ()}) + ["GO", "K", "İ", "ß", "123", "Cat", "dog", "ABC", "abcd", "ab", "cd", "x", "\n", "foobar", "Kit", "=", "$7", "`a` `b`", "SERIAL"]
    scan = Scanner(rules)
    for _ in range(400):
        text = rng.choice(["", " ", "/", "."]).join(w.upper() if rng.random() < 0.3 else w for w in rng.choices(words, k=rng.randrange(12)))
        assert scan.hits(text) == [n for n, p in rules if re.search(p, text, re.ASCII)], text


def test_more_rules_are_not_more_searches():
    text = " ".join(f"word{i} DbContext" for i in range(50))
    few, many = Scanner(tuple(RULES)), Scanner(tuple(RULES + [(f"r{i}", f"(?i)absent{i}\\b") for i in range(1000)]))
    assert many.candidates(text) == few.candidates(text) and len(few.candidates(text)) < 12


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [("a", "from fastapi", 1), ("a", "from fastapi", 2), ("b", None, 3), ("c", "", 4), (None, "graphql", 5), ("d", "x" * 1_000_000 + "grpc ", 6)]
    df = spark.createDataFrame(rows, "path string, text string, rule int")
    assert sorted(((r.path or "", r.rule) for r in rule_hits(df, [*T.STYLES, T.STYLES[0]]).collect())) == [("", "graphql"), ("a", "fastapi"), ("a", "fastapi"), ("d", "grpc")]
    assert rule_hits(df.limit(0), list(T.STYLES)).collect() == [] and rule_hits(df, []).collect() == []
