"""Graph operators over edges (src, dst, kind, pos).

Paths, components and distances are in metaloom.operators.paths. Rounds are written tables, so a lost executor costs no more
than a round. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.operators.paths import ancestor_counts, chains, components, cycles, distances, simple  # noqa: F401
from metaloom.sources.scratch import cut

HUB_DEGREE = 4


def ego(edges: DataFrame, center: str, radius: int) -> DataFrame:
    """Nodes within radius out-edges of center."""
    front = edges.select(F.col("dst").alias("node"), F.col("src")).where(F.col("src") == center).select("node", F.lit(1).alias("hops"))
    out = front
    for n in range(2, radius + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(n).alias("hops"))
        out = out.union(front)
    return out.where(F.col("node") != center).groupBy("node").agg(F.min("hops").alias("hops"))


def dependency_depth(edges: DataFrame) -> DataFrame:
    """For each node with ancestors, the largest of their shortest distances."""
    return distances(edges).groupBy(F.col("dst").alias("node")).agg(F.max("distance").alias("depth"), F.count(F.lit(1)).alias("n_ancestors"))


def cross_domain_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different domains within two edges, with the length and the smallest middle node."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    one = e.select("src", "dst", F.lit(1).alias("hops"), F.lit("").alias("via"))
    two = e.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").where("src <> dst").select("src", "dst", F.lit(2).alias("hops"), "via")
    both = one.union(two).groupBy("src", "dst").agg(F.min(F.struct("hops", "via")).alias("m")).select("src", "dst", "m.hops", "m.via")
    dom = lambda c: nodes.select(F.col("node").alias(c), F.col("domain").alias(f"{c}_domain"))
    return both.join(dom("src"), "src").join(dom("dst"), "dst").where("src_domain <> dst_domain")


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree, hub from HUB_DEGREE edges; one aggregation over edge ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out")).withColumn("is_hub", F.col("n_in") + F.col("n_out") >= HUB_DEGREE)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge; a self-loop counts as an edge."""
    used = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(used, "node", "left_anti").select("node")


def call_depths(procs: DataFrame, calls: DataFrame) -> DataFrame:
    """Fewest calls from an uncalled procedure, names case-insensitive; 0 where no such procedure leads."""
    step = cut(calls.select(F.lower("caller").alias("a"), F.lower("callee").alias("b")).distinct())
    front = cut(procs.select(F.lower("proc").alias("p")).distinct().join(step.select(F.col("b").alias("p")), "p", "left_anti").withColumn("depth", F.lit(0)))
    known = front
    for n in count(1):
        after = front.join(step, F.col("p") == F.col("a")).select(F.col("b").alias("p")).distinct().join(known, "p", "left_anti")
        front = cut(after.withColumn("depth", F.lit(n)))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return procs.select("proc").join(known, F.lower("proc") == F.col("p"), "left").select("proc", F.coalesce("depth", F.lit(0)).alias("call_depth"))


def flow_edges(steps: DataFrame) -> DataFrame:
    """Consecutive steps of a flow; the weaker confidence of both ends."""
    w = Window.partitionBy("flow").orderBy("pos")
    rank = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    nxt = steps.withColumns({"dst": F.lead("component").over(w), "r": F.least(rank, F.lead(rank).over(w))}).where("dst IS NOT NULL")
    return nxt.select("flow", F.col("component").alias("src"), "dst", F.when(F.col("r") == 3, "HIGH").when(F.col("r") == 2, "MEDIUM").otherwise("LOW").alias("confidence"))


def flows(steps: DataFrame) -> DataFrame:
    """A flow has a gap without an entity step; overall confidence is its weakest step's."""
    rank = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    g = steps.groupBy("flow").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "layer"))), lambda x: x.layer), ">").alias("layers"), (~F.bool_or(F.col("layer") == "entity")).alias("has_gaps"), F.min(rank).alias("r"))
    return g.select("flow", "layers", "has_gaps", F.when(F.col("r") == 3, "HIGH").when(F.col("r") == 2, "MEDIUM").otherwise("LOW").alias("confidence"))


def inheritance(entities: DataFrame, limit: int = 5) -> DataFrame:
    """Up to limit levels along the first base; every level lists all bases. entity, level, bases."""
    own = entities.select("entity", F.split("bases", ",").alias("b")).where("bases <> ''")
    now = own.select("entity", F.lit(1).alias("level"), F.array_join("b", ",").alias("bases"), F.element_at("b", 1).alias("up"))
    out = now
    for n in range(2, limit + 1):
        now = now.join(own.select(F.col("entity").alias("up"), "b"), "up").select("entity", F.lit(n).alias("level"), F.array_join("b", ",").alias("bases"), F.element_at("b", 1).alias("up"))
        out = out.union(now)
    return out.select("entity", "level", "bases")
