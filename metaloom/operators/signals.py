"""Many patterns over each text once.

Of each pattern the literals are derived that any match must hold one of (in lower case). One automaton over the literals of
all patterns reads a text once; only patterns whose literal it meets are searched in the text themselves, and those from which
no literal follows. More patterns make a larger automaton, not more passes.

Patterns are searched with ASCII classes and ASCII case, as the JVM's are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 2  # shorter literals are in nearly all texts


def _needed(items) -> frozenset[str] | None:
    """Literals one of which is in whatever a parsed sequence matches; None where none follows."""
    from re import _constants as op

    options, run = [], []

    def close() -> None:
        if run:
            options.append(frozenset({"".join(run)}))
            run.clear()

    for kind, arg in items:
        if kind is op.LITERAL:
            run.append(chr(arg).lower())
            continue
        if kind is op.AT:  # takes no character
            continue
        close()
        inner = None
        if kind is op.SUBPATTERN:
            inner = _needed(arg[3])
        elif kind is op.BRANCH:
            each = [_needed(b) for b in arg[1]]
            inner = None if any(e is None for e in each) else frozenset().union(*each)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        elif kind is op.ATOMIC_GROUP:
            inner = _needed(arg)
        if inner is not None:
            options.append(inner)
    close()
    good = [o for o in options if min(map(len, o)) >= LEAST]
    return max(good, key=lambda o: (min(map(len, o)), -len(o))) if good else None


def literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals one of which any match of the pattern holds, or None where none follows from it."""
    from re import _parser

    return _needed(_parser.parse(pattern, re.ASCII))


class Scanner:
    """Which of the (name, pattern) rules a text has."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        import ahocorasick

        self.names = [n for n, _ in rules]
        self.patterns = [re.compile(p, re.ASCII) for _, p in rules]
        self.always, of = [], {}
        for i, (_, p) in enumerate(rules):
            found = literals(p)
            if found is None:
                self.always.append(i)
            for word in found or ():
                of.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, numbers in of.items():
            self.automaton.add_word(word, tuple(numbers))
        if of:
            self.automaton.make_automaton()
        self.literal = bool(of)

    def candidates(self, text: str) -> list[int]:
        """Numbers of the rules that have to be searched in text."""
        met = set(self.always)
        if self.literal:
            for _, numbers in self.automaton.iter(text.lower()):
                met.update(numbers)
        return sorted(met)

    def hits(self, text: str) -> list[str]:
        return [self.names[i] for i in self.candidates(text) if self.patterns[i].search(text)]


@lru_cache(maxsize=4)
def scanner(rules: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(rules)


def rule_hits(texts: DataFrame, rules: list[tuple[str, str]], key: str = "path", text: str = "text") -> DataFrame:
    """(key, rule) for each rule (name, pattern) that a row's text has, once a row. Null texts and an empty list of rules give
    none; rows that share a key each give their own; other columns are left out."""
    frozen = tuple(dict.fromkeys(rules))
    of = texts.schema[key].dataType
    schema = f"{key} {of.simpleString()}, rule string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(frozen)
        for batch in batches:
            at, names = [], []
            for i, t in enumerate(batch.column(1)):
                found = list(dict.fromkeys(scan.hits(t.as_py()))) if t.is_valid else []
                at += [i] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], [key, "rule"])

    return texts.select(key, text).mapInArrow(run, schema)
