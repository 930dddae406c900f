"""Redundancy: clones by Jaccard similarity over an inverted index, repeated fields, structural duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.sources.scratch import cut, keep

THRESHOLD = 0.7
#: Owners that make an item, and parts that the owners of one kind of item are dealt over.
ITEM, PARTS = 128, 64
#: What the items of a block weigh, and what an item weighs besides its owners, so that a block has 512 items at most.
BLOCK, EXTRA = 4096, 7
#: Owners that a rare feature has at most.
RARE = 64


def _owners(members: DataFrame, threshold: float, least: int) -> DataFrame:
    """(owner, f, marks, own, keys, more): the features of each set from the rarest, those of RARE owners at most (marks: of
    two or more), and how many of the rare (keys) and of the other ones (more) may be the first that two alike sets share."""
    m = members.where("owner IS NOT NULL AND feature IS NOT NULL").distinct()
    sets = m.groupBy("owner").agg(F.sort_array(F.collect_list("feature")).alias("s")).where(F.size("s") >= least)
    owners = cut(sets)
    often = owners.select(F.explode("s").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    kinds = owners.select("s").distinct()
    named = kinds.select("s", F.explode("s").alias("feature")).join(often.hint("merge"), "feature")
    lists = named.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("df", "feature"))).alias("x"))
    of = lambda where: F.transform(F.filter("x", where), lambda x: x["feature"])
    known = lists.select("s", F.transform("x", lambda x: x["feature"]).alias("f"), of(lambda x: (x["df"] > 1) & (x["df"] <= RARE)).alias("marks"), of(lambda x: x["df"] == 1).alias("own"))
    n, lone, rare = F.size("f"), F.size("own"), F.size("own") + F.size("marks")
    prefix = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    known = known.withColumns({"keys": F.greatest(F.least(prefix, rare) - lone, F.lit(0)), "more": F.greatest(prefix - rare, F.lit(0))})
    return owners.join(known.hint("merge"), "s").drop("s")


def _blocks(members: DataFrame, threshold: float, least: int) -> DataFrame:
    """(key, block, items): the items of each feature that may be the first that two alike sets share. Under a rare feature an
    item is a set, under others what sets without their rare features have in common, with ITEM owners at most; each of these
    keeps its rare ones."""
    owners = _owners(members, threshold, least)
    none, some, rare = F.lit(None).cast(owners.schema["f"].dataType), lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c), F.size("own") + F.size("marks")
    whole = owners.where("keys > 0").select(F.lit(True).alias("rare"), "f", F.size("f").alias("n"), F.slice("f", F.size("own") + 1, F.col("keys")).alias("keys"), F.struct("owner", none.alias("marks"), none.alias("own")).alias("e"))
    core = F.slice("f", rare + 1, F.greatest(F.size("f") - rare, F.lit(0)))
    other = owners.where("more > 0").select(F.lit(False).alias("rare"), core.alias("f"), F.size("f").alias("n"), F.slice("f", rare + 1, F.col("more")).alias("keys"), F.struct("owner", some("marks"), some("own")).alias("e"))
    kind = ("rare", "f", "n", "keys", "part")
    dealt = whole.union(other).withColumn("part", F.pmod(F.xxhash64("e.owner"), F.lit(PARTS)))
    placed = dealt.withColumn("at", F.floor((F.row_number().over(Window.partitionBy(*kind).orderBy("e.owner")) - 1) / ITEM))
    items = cut(placed.groupBy(*kind, "at").agg(F.min("e.owner").alias("id"), F.collect_list("e").alias("of")))
    alone = items.select("rare", "f", "n", "keys").distinct().select("f", F.explode("keys").alias("key")).groupBy("key").agg((F.count(F.lit(1)) == 1).alias("alone"), F.first("f").alias("g"))
    met = alone.where(~F.col("alone") | (F.col("key") == F.element_at("g", 1))).select("key")  # what meets itself only does so once
    rows = items.select(F.explode("keys").alias("key"), "part", (F.size("of") + EXTRA).alias("w"), F.struct("id", "n", "f", "of").alias("item")).join(met.hint("merge"), "key", "left_semi")
    heavy = F.floor((F.sum("w").over(Window.partitionBy("key", "part").orderBy("item.id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")) / BLOCK)
    blocks = rows.withColumn("b", heavy).groupBy("key", "part", "b").agg(F.collect_list("item").alias("items"))
    return blocks.select("key", (F.col("b") * PARTS + F.col("part")).alias("block"), "items")


def _alike(members: DataFrame, threshold: float, least: int) -> DataFrame:
    """(_self, p, q, both, total): pairs of items whose owners' sets have Jaccard similarity threshold or more where they
    share no mark, with their common features and the size of the union.

    Prefix filter: with features ordered from the rarest, two such sets share one among the first
    size - ceil(threshold * size) + 1, so items only meet under these, and their pair counts under the first feature that
    they share. Sets that share a rare feature meet under it, whole. Of others only the frequent features matter, so all sets
    with the same ones and of one size are compared as one. Blocks of items are shuffled, not pairs: a task makes the pairs of
    two blocks as it writes them."""
    blocks = keep(_blocks(members, threshold, least))
    side = lambda c: blocks.select("key", F.col("block").alias(f"b{c}"), F.col("items").alias(f"i{c}"))
    met = side("x").join(side("y").hint("merge"), "key").where("bx <= by").repartition(8 * members.sparkSession.sparkContext.defaultParallelism, "key", "bx", "by")
    one = met.select("key", (F.col("bx") == F.col("by")).alias("same"), "iy", F.explode("ix").alias("p"))
    two = one.select("key", "same", "p", F.explode("iy").alias("q"))
    two = two.where("NOT same OR p.id <= q.id").where(F.least("p.n", "q.n") >= F.greatest("p.n", "q.n") * threshold - 1e-9)
    two = two.select("key", "same", "p", "q", F.explode_outer(F.array(F.array_intersect("p.f", "q.f"))).alias("both")).where(F.col("key") == F.element_at("both", 1))  # made once
    size = F.size("both")
    two = two.where(size / (F.col("p.n") + F.col("q.n") - size) >= threshold - 1e-12)
    self = F.col("same") & (F.col("p.id") == F.col("q.id"))
    return two.select(self.alias("_self"), "p", "q", "both", (F.col("p.n") + F.col("q.n") - size).alias("total"))


def _pairs(found: DataFrame, names: list[str], owner) -> DataFrame:
    """found with a row for each pair of owners (x, y) that share no mark in place of one for two items; owner gives what is
    told of an owner of an item. The transforms have Spark make each row whole before it is spread, so nothing but the pair's
    own columns is made anew for each pair; explode would have them made again to filter out empty arrays, explode_outer not."""
    told = lambda c: F.transform(f"{c}.of", lambda e: F.struct(e["owner"].alias("id"), e["marks"].alias("marks"), *owner(c, e)))
    rows = found.select("_self", *names, told("p").alias("_xs"), told("q").alias("_ys"))
    wide = rows.select("_self", *names, "_ys", F.explode_outer("_xs").alias("x")).select("_self", *names, "x", F.explode_outer("_ys").alias("y"))
    one = lambda c: F.size(f"{c}.marks") == 1
    shared = F.when(one("x") & one("y"), F.element_at("x.marks", 1) == F.element_at("y.marks", 1)).otherwise(F.arrays_overlap("x.marks", "y.marks"))
    free = F.isnull("x.marks") | F.isnull("y.marks") | ~shared
    return wide.where("NOT _self OR x.id < y.id").where(free)


def clones(members: DataFrame, threshold: float = THRESHOLD, least: int = 2) -> DataFrame:
    """(a, b, common, total) of pairs of owners that are alike."""
    told = _alike(members, threshold, least).withColumns({"common": F.size("both").cast("long"), "total": F.col("total").cast("long")})
    return _pairs(told, ["common", "total"], lambda c, e: []).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "common", "total")


def clone_findings(members: DataFrame, threshold: float = THRESHOLD, least: int = 2) -> DataFrame:
    """(a, b, overlap_pct, severity, confidence, shared, unique_a, unique_b): the overlap in percent with one
    decimal, a warning from 80 on, high confidence from 90 on, and the sorted names that both have or one alone."""
    share = F.size("both") / F.col("total")
    listed = lambda x: F.array_join(F.sort_array(x), ",")
    told = _alike(members, threshold, least).withColumns({
        "overlap_pct": F.bround(share * 100, 1), "severity": F.when(share >= 0.8, "WARNING").otherwise("NOTE"), "confidence": F.when(share >= 0.9, "HIGH").otherwise("MEDIUM"),
        "shared": listed(F.col("both")), "_p": listed(F.array_except("p.f", "both")), "_q": listed(F.array_except("q.f", "both")),
    })
    rest = lambda e: F.concat(F.coalesce(e["marks"], F.array()), F.coalesce(e["own"], F.array()))
    alone = lambda c, e: [F.when(e["marks"].isNotNull() | e["own"].isNotNull(), listed(F.concat(F.array_except(f"{c}.f", "both"), rest(e)))).alias("alone")]
    rows, swapped = _pairs(told, ["overlap_pct", "severity", "confidence", "shared", "_p", "_q"], alone), F.col("x.id") > F.col("y.id")
    x, y = F.coalesce("x.alone", "_p"), F.coalesce("y.alone", "_q")
    return rows.select(
        F.when(swapped, F.col("y.id")).otherwise(F.col("x.id")).alias("a"), F.when(swapped, F.col("x.id")).otherwise(F.col("y.id")).alias("b"), "overlap_pct", "severity", "confidence", "shared",
        F.when(swapped, y).otherwise(x).alias("unique_a"), F.when(swapped, x).otherwise(y).alias("unique_b"),
    )


def repeated_fields(fields: DataFrame) -> DataFrame:
    """Field names of three owners or more; actionable from four; whether all have one type."""
    plain = fields.where("NOT is_nav AND lower(field) NOT IN ('id', 'name', 'createdat', 'updatedat', 'isdeleted')")
    return plain.groupBy("field").agg(F.countDistinct("entity").alias("owners"), (F.countDistinct("type") == 1).alias("same_type")).where("owners >= 3").withColumn("actionable", F.col("owners") >= 4)


def shared_keys(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Key-like fields of two owners or more in two aggregates or more."""
    keys = fields.where("field RLIKE '(?i).+id$'").join(entities.select("entity", "aggregate"), "entity")
    return keys.groupBy("field").agg(F.countDistinct("entity").alias("owners"), F.countDistinct("aggregate").alias("aggregates")).where("owners >= 2 AND aggregates >= 2")


def structural(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Entities with the same sorted bases and sorted fields."""
    f = fields.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("f"))
    shape = entities.join(f, "entity", "left").select("entity", F.array_join(F.array_sort(F.split("bases", ",")), ",").alias("b"), F.coalesce("f", F.lit("")).alias("f"))
    return shape.groupBy("b", "f").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("entity")), ",").alias("entities")).where("n >= 2").select(F.col("b").alias("bases"), F.col("f").alias("fields"), "n", "entities")
