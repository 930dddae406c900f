"""Aggregates by name (X08, X09), what guards them (D01, D03, D06), and orders of findings.

Names that are null count as empty. Rows that a name does not fit are kept with the last rule's answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators import code as C
from metaloom.operators.ranks import numbered

#: Parts of names that tell nothing, of namespaces and folders, packages, and modules (the last two in lower case).
GENERIC_SEGMENTS = ("Entities", "Models", "ApplicationCore", "Infrastructure", "Application", "Persistence", "Data", "Business", "src", "lib", "main", "Aggregates", "ValueObjects")
GENERIC_PACKAGES = ("entity", "entities", "model", "models", "domain", "persistence", "repository", "service", "dto")
GENERIC_MODULES = ("models", "entities", "domain", "core", "app", "apps", "src", "base", "abstract", "common")
#: The order of severities and of confidences; others come last.
SEVERITIES, CONFIDENCES = ("CRITICAL", "WARNING", "NOTE"), ("HIGH", "MEDIUM", "LOW")
WORD = "Aggregate"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _last(parts: Column, fits) -> Column:
    return F.try_element_at(F.filter(parts, fits), F.lit(-1))


def _folders(path: Column) -> Column:
    return F.filter(F.split(_text(path), r"[/\\]+"), lambda p: ~p.isin("", "."))


def aggregate_of(namespace: Column, entity: Column, path: Column) -> Column:
    """The first part named XxxAggregate of the namespace, else of the path; else the file's folder, else the last part of
    the namespace that tells something; else the entity's own."""
    named = lambda p: p.endswith(WORD) & (F.length(p) > len(WORD))
    parts, folders = F.split(_text(namespace), r"\."), _folders(path)
    parent = F.when(F.size(folders) > 1, F.element_at(folders, -2))
    return F.coalesce(
        F.try_element_at(F.filter(parts, named), F.lit(1)),
        F.try_element_at(F.filter(folders, named), F.lit(1)),
        F.when(~parent.isin(*GENERIC_SEGMENTS), parent),
        _last(parts, lambda p: (F.length(p) > 2) & ~p.isin(*GENERIC_SEGMENTS)),
        F.concat(_text(entity), F.lit(WORD)),
    )


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 10_000)), F.lit(WORD))


def aggregate_of_package(package: Column, entity: Column) -> Column:
    """The last telling part of a package as XxxAggregate, else the entity's own."""
    part = _last(F.split(_text(package), r"\."), lambda p: (F.length(p) > 2) & ~F.lower(p).isin(*GENERIC_PACKAGES))
    return F.coalesce(_capital(part), F.concat(_text(entity), F.lit(WORD)))


def aggregate_of_module(path: Column, entity: Column) -> Column:
    """The last telling folder of a module's path as XxxAggregate, else the entity's own."""
    folders = _folders(path)
    above = F.transform(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda p: F.replace(F.lower(p), F.lit(".py"), F.lit("")))
    part = _last(above, lambda p: (F.length(p) > 2) & ~p.isin(*GENERIC_MODULES))
    return F.coalesce(_capital(part), F.concat(_text(entity), F.lit(WORD)))


def _joined(values: Column) -> Column:
    return F.array_join(F.sort_array(values), ",")


def guarded_roots(entities: DataFrame, properties: DataFrame, parameters: DataFrame) -> DataFrame:
    """(entity, exposed, has_encapsulation_issue, has_guard_clauses) of aggregate roots: their collections of other types
    that others can change, and whether a constructor takes parameters.

    entities: entity, is_root; properties: entity, name, setter, category; parameters: entity, param."""
    roots = entities.where("is_root").select("entity").distinct()
    open_ = properties.where("category = 'collection' AND setter IN ('public', 'none')").groupBy("entity").agg(_joined(F.collect_set("name")).alias("exposed"))  # a class's own
    guards = parameters.groupBy("entity").agg(F.lit(True).alias("g"))
    each = roots.join(open_, "entity", "left").join(guards, "entity", "left")
    return each.select("entity", _text(F.col("exposed")).alias("exposed"), F.col("exposed").isNotNull().alias("has_encapsulation_issue"), F.coalesce("g", F.lit(False)).alias("has_guard_clauses"))


def invariants_of(entities: DataFrame, properties: DataFrame, parameters: DataFrame, first: int = 5) -> DataFrame:
    """(entity, kind, names): constructor_guard with all parameters by name, private_setter_invariant with the first
    fields by name that others cannot set, navigations not counted."""
    known = entities.select("entity").distinct()
    guards = parameters.groupBy("entity").agg(_joined(F.collect_set("param")).alias("names")).select("entity", F.lit("constructor_guard").alias("kind"), "names")
    closed = properties.where("setter IN ('private', 'none') AND category NOT IN ('navigation', 'collection')").groupBy("entity").agg(F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, first), ",").alias("names"))
    return guards.union(closed.select("entity", F.lit("private_setter_invariant"), "names")).join(known, "entity", "left_semi").select("entity", "kind", "names")


def mapper_profiles(files: DataFrame) -> DataFrame:
    """(path, name, mappings) of the classes whose body maps types: source>destination, comma-joined by name."""
    pair = r"CreateMap\s*<\s*(\w+)\s*,\s*(\w+)\s*>"
    at = lambda g: F.regexp_extract_all("body", F.lit(pair), F.lit(g))
    maps = F.zip_with(at(1), at(2), lambda a, b: F.concat(a, F.lit(">"), b))
    return C.bodies(files.where(F.col("text").contains("CreateMap"))).select("path", "name", _joined(F.array_distinct(maps)).alias("mappings")).where("mappings <> ''")


def anti_corruption_layers(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """(name, kind, mappings): mapper profiles, and entities whose name tells of a snapshot."""
    snaps = entities.where("contains(entity, 'Ordered') OR contains(entity, 'Snapshot')").select(F.col("entity").alias("name"), F.lit("snapshot_acl").alias("kind"), F.lit("").alias("mappings"))
    return profiles.select("name", F.lit("automapper_profile").alias("kind"), "mappings").union(snaps)


# ---- orders and subsets of findings


def _place(c: str, order: tuple[str, ...]) -> Column:
    rank = F
    for i, value in enumerate(order):
        rank = rank.when(F.col(c) == value, i)
    return rank.otherwise(len(order))


def by_severity(findings: DataFrame, then: list[str]) -> DataFrame:
    """Findings with their place, critical ones first; the other columns should tell any two apart. Places come from
    ranges (ranks.numbered), so that no task holds a severity's findings."""
    return numbered(findings, [_place("severity", SEVERITIES), *map(F.col, then)], "place")


def by_confidence(findings: DataFrame, then: list[str]) -> DataFrame:
    """Findings with their place, the surest first."""
    return numbered(findings, [_place("confidence", CONFIDENCES), *map(F.col, then)], "place")


def by_source(relations: DataFrame, then: list[str]) -> DataFrame:
    """Relations with their place by source, in their own order among equals."""
    return numbered(relations, [F.col("source"), *map(F.col, then)], "place")


def count_by(findings: DataFrame, key: str) -> DataFrame:
    """(value, n); null counts as unknown."""
    return findings.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def subsets(findings: DataFrame) -> DataFrame:
    """findings once for each subset that they belong to: gdpr (with a category) and pci (rule pci_dss)."""
    of = F.array_compact(F.array(F.when(F.col("category") != "", "gdpr"), F.when(F.col("rule") == "pci_dss", "pci")))
    return findings.withColumn("subset", F.explode(of))
