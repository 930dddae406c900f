"""Paths in graphs of any size: chains, strongly connected components, cycles, shortest distances, reach.

Edges are rows (src, dst, ...). Each round is a written table that only holds what is new; only counts reach the driver.
What a call writes on the way goes at its end, but for its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from metaloom.sources.scratch import cut, keep, workspace

MAX_NODES, START_TABLES = 6, 30


def simple(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), the last one written."""
    return edges.groupBy("src", "dst").agg(F.max_by("kind", "pos").alias("kind"))


def leading_edges(edges: DataFrame, left: int) -> list[DataFrame]:
    """For r = 0 to left: the edges (src, dst) after which an end can lie r more edges ahead, or a node without out-edges in
    fewer. Behind u -> v a path must go on to a third node w, so an edge leads on if v has no out-edges or an edge to such a
    w leads on with r - 1. Two different w of each v are enough to tell, so a step aggregates, whatever the degree."""
    step = edges.select("src", "dst").where("src <> dst").distinct()
    sinks = edges.select(F.col("dst").alias("src")).join(edges.select("src").distinct(), "src", "left_anti").distinct()
    at_end = step.join(sinks.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    found = [cut(step)]
    for _ in range(left):
        ahead = found[-1].groupBy("src").agg(F.min("dst").alias("low"), F.max("dst").alias("high")).withColumnRenamed("src", "dst")
        on = step.join(ahead, "dst").where("low <> src OR high <> src").select("src", "dst")
        found.append(cut(on.unionByName(at_end).distinct()))
    return found


def chains(edges: DataFrame, starts: int = START_TABLES, max_nodes: int = MAX_NODES, writes: tuple[str, ...] = ("write",), first: DataFrame | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Simple paths from the first start nodes by name (of first's, or of all) up to a node without out-edges or max_nodes
    nodes. A path whose every successor lies on it is dropped. path, kinds, depth, has_write, risk.

    Only the edges that the starts reach in time are looked at, and a path grows only along edges from which an end can be
    reached (leading_edges), so that a hub's dead ends make no rows. sizes gets the paths of each round."""
    spark = edges.sparkSession
    with workspace(spark):
        all_edges = cut(simple(edges))
        nodes = all_edges.select(F.col("src").alias("node")).union(all_edges.select("dst")) if first is None else first
        front = cut(nodes.distinct().orderBy("node").limit(starts))
        begin, seen = front, front
        for _ in range(max_nodes - 2):
            front = cut(all_edges.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.union(front)
        near = cut(all_edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi"))
        # A node beyond the last round has no out-edges in near, but the paths end there by length.
        lead = leading_edges(near, max_nodes - 2)
        paths = begin.select(F.array("node").alias("path"), F.array().cast("array<string>").alias("kinds"))
        sources = near.select("src").distinct()
        out = None
        for n in range(2, max_nodes + 1):
            step = near.join(lead[max_nodes - n], ["src", "dst"], "left_semi").select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("kind").alias("k"))
            grown = paths.join(step, F.element_at("path", -1) == F.col("s")).where(~F.array_contains("path", F.col("d")))
            paths = cut(grown.select(F.array_append("path", F.col("d")).alias("path"), F.array_append("kinds", F.col("k")).alias("kinds")))
            if sizes is not None:
                sizes.append(paths.count())
            done = paths if n == max_nodes else paths.join(sources, F.element_at("path", -1) == F.col("src"), "left_anti")
            out = done if out is None else out.union(done)
        write = F.exists("kinds", lambda k: k.isin(*writes))
        return keep(out.select(F.array_join("path", "→").alias("path"), F.array_join("kinds", ",").alias("kinds"), (F.size("path") - 1).alias("depth"), write.alias("has_write"), F.when(write, "MEDIUM").otherwise("LOW").alias("risk")))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the graph. A file of many alike names is far smaller than its rows, so that Spark
    would take such a table for one to broadcast, and each task would hold it whole."""
    return left.join(right.hint("merge"), on, how)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that begin where none ends or end where none begins, until there are none to drop: a round for each
    two edges of the longest path outside components."""
    now, before = edges, -1
    while True:
        ended = _met(now, now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        now = cut(_met(ended, now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        after = now.count()
        if after in (before, 0):
            return now
        before = after


#: Edges that one task may take, some 100 MB there: graphs and blocks of this size are finished in one step.
LOCAL_EDGES = 300_000


def _tarjan(pairs: list[tuple]) -> dict:
    """node -> smallest node of its component, for components of several nodes."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    index, low, on, stack, found, n = {}, {}, set(), [], {}, 0
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = n
        n += 1
        stack.append(root)
        on.add(root)
        while work:
            v, ahead = work[-1]
            for w in ahead:
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == v:
                            break
                    if len(part) > 1:
                        found |= dict.fromkeys(part, min(part))
    return found


def _finished(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (src, dst, block) in which a block's rows follow each other, LOCAL_EDGES at most."""
    kind = edges.schema["src"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if found := _tarjan(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["node", "component"])

        for batch in batches:
            for of, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "src", "dst"))):
                if of != block:
                    yield from done()
                    block, pairs = of, []
                pairs.append((a, b))
        yield from done()

    return edges.mapInArrow(run, StructType([StructField("node", kind), StructField("component", kind)]))


def _blocks(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(src, dst, block): edges by the weakly connected part that they lie in.

    In each round a node goes over into its smallest neighbour, itself included, and edges are kept between what is left, under
    new random numbers, so that rounds go with the logarithm of the nodes and get smaller. Nodes are hashes throughout: equal
    ones only put two parts into one block. rounds gets the edges before each."""
    step = edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    between = lambda df: cut(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    step, ups = between(step), []
    for n in count(1):
        if rounds is not None:
            rounds.append(step.count())
        least = step.union(step.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        up = cut(least.select("a", F.xxhash64(F.least("a", "b"), F.lit(n)).alias("up")))
        ups.append(up)
        half = _met(step, up, "a").select("b", F.col("up").alias("_a"))
        step = between(_met(half, up.withColumnRenamed("a", "b"), "b").select(F.col("_a").alias("a"), F.col("up").alias("b")))
        if step.isEmpty():
            break
    block = ups.pop()
    while ups:
        block = _met(ups.pop(), block.select(F.col("a").alias("up"), F.col("up").alias("last")), "up", "left").select("a", F.coalesce("last", "up").alias("up"))
        block = cut(block)
    named = edges.select("src", "dst", F.xxhash64("src").alias("a"))
    return cut(_met(named, block, "a").select("src", "dst", F.col("up").alias("block")))


#: Edges of small blocks that a task sorts and reads one after the other.
DEALT_EDGES = 250_000


def _settled(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((node, component) of the blocks of LOCAL_EDGES edges at most, edges of the larger ones)."""
    blocks = _blocks(edges)
    large = F.broadcast(cut(blocks.groupBy("block").count().where(F.col("count") > LOCAL_EDGES).select("block")))  # few, as each has many edges
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, size // DEALT_EDGES + 1)
    small = blocks.join(large, "block", "left_anti").repartition(tasks, "block").sortWithinPartitions("block")
    return cut(_finished(small)), cut(blocks.join(large, "block", "left_semi").select("src", "dst"))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) of the nodes on cycles; component is the smallest node of the strongly connected component. A
    node with an edge to itself alone is a component of its own.

    A graph of LOCAL_EDGES edges at most is one task's. A larger one is dealt by its weakly connected blocks, of which a task
    takes those up to that size, one after the other. Of a larger block, what cannot lie on a cycle is trimmed. Then each node
    takes the smallest node that reaches it as its colour (with jumps to the colour's own colour), a component is what reaches
    its colour's node within the colour, and what is left goes on within its colour. rounds gets the edges left before each
    such pass; without cycles there is none after the trim. Edges with a null end lie on no cycle."""
    with workspace(edges.sparkSession):
        given = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
        loops = given.where("src = dst").select(F.col("src").alias("node"))
        now, found = given.where("src <> dst"), []
        while (size := now.count()) > 0:
            if size <= LOCAL_EDGES:
                found.append(cut(_finished(now.select("src", "dst", F.lit(0).alias("block")).coalesce(1))))
                break
            few, now = _settled(now, size)
            found.append(few)
            if now.isEmpty():
                break
            now = _trimmed(now)
            if now.isEmpty():
                break
            if rounds is not None:
                rounds.append(now.count())
            colour = cut(now.select(F.col("src").alias("node")).union(now.select("dst")).distinct().withColumn("c", F.col("node")))
            while True:
                told = _met(now, colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
                least = colour.union(told).groupBy("node").agg(F.min("c").alias("c"))
                jumped = _met(least, colour.select(F.col("node").alias("c"), F.col("c").alias("j")), "c").select("node", F.least("c", "j").alias("c"))
                after = cut(jumped)
                moved = _met(after, colour, ["node", "c"], "left_anti").isEmpty()
                colour = after
                if moved:
                    break
            coloured = _met(_met(now, colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src"), colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
            inside = cut(coloured.where("a = b").select("src", "dst", F.col("a").alias("c")))
            front = inside.where("dst = c").select(F.col("src").alias("node"), "c").distinct()
            front = cut(front.union(inside.where("src = c OR dst = c").select(F.col("c").alias("node"), "c")).distinct())
            reach = front
            while True:
                behind = _met(inside, front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
                front = cut(_met(behind, reach, ["node", "c"], "left_anti"))
                if front.isEmpty():
                    break
                reach = reach.union(front)
            hit = inside.select(F.col("dst").alias("node")).distinct()
            own = cut(_met(reach, hit, "node", "left_semi").select("node", F.col("c").alias("component")))
            own = cut(_met(own, own.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component"))
            found.append(own)
            left = _met(_met(inside, reach.select(F.col("node").alias("src")), "src", "left_anti"), reach.select(F.col("node").alias("dst")), "dst", "left_anti")
            now = cut(left.select("src", "dst"))
        out = loops.select("node", F.col("node").alias("component"))
        if found:
            several = found[0]
            for f in found[1:]:
                several = several.union(f)
            out = several.union(_met(out, several.select("node"), "node", "left_anti"))
        return keep(out)


def cycles(edges: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """Simple cycles of any length, each once, starting at its smallest node. Walks stay inside a component and above
    their first node; sizes gets the open walks of each round, and an acyclic graph has none."""
    with workspace(edges.sparkSession):
        known = cut(components(edges))
        within = edges.select("src", "dst").distinct().join(known.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(known.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        step = cut(within.where("a = b").select(F.col("src").alias("s"), F.col("dst").alias("d")))
        paths = cut(step.where("s <= d").select(F.array("s").alias("path"), "d"))
        out = []
        while True:
            if sizes is not None:
                sizes.append(paths.count())
            out.append(paths.where(F.col("d") == F.element_at("path", 1)).select(F.array_join("path", "→").alias("cycle"), F.size("path").alias("length")))
            open_ = paths.where((F.col("d") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("d")))
            paths = cut(open_.select(F.array_append("path", F.col("d")).alias("path")).join(step, F.element_at("path", -1) == F.col("s")).where((F.col("d") >= F.element_at("path", 1)) & ((F.col("d") == F.element_at("path", 1)) | ~F.array_contains("path", F.col("d")))).select("path", "d"))
            if paths.isEmpty():
                break
        every = out[0]
        for o in out[1:]:
            every = every.union(o)
        return keep(every)


def distances(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Src, dst, distance (fewest edges) for each pair of different nodes that a path joins.

    Paths double: a shortest path of 2^k + 1 to 2^(k+1) edges is one of exactly 2^k edges and one of up to 2^k, so a round
    joins the pairs at exactly 2^k with all known ones and adds the pairs that are new. Rounds go with the logarithm of the
    longest distance, and each adds its own table; none is written again. rounds gets the new pairs of each."""
    with workspace(edges.sparkSession):
        step = cut(edges.select("src", "dst").where("src <> dst").distinct().withColumn("distance", F.lit(1)))
        known, reach = step, 1
        while True:
            half = known.where(F.col("distance") == reach).select("src", F.col("dst").alias("via"))
            grown = half.join(known.select(F.col("src").alias("via"), "dst", "distance"), "via").where("src <> dst")
            new = grown.groupBy("src", "dst").agg((F.min("distance") + reach).alias("distance"))
            delta = cut(new.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
            n = delta.count()
            if rounds is not None:
                rounds.append(n)
            if not n:
                break
            known, reach = known.unionByName(delta), 2 * reach
        return keep(known)


def ancestor_counts(edges: DataFrame) -> DataFrame:
    """(node, n_ancestors) of nodes that others reach: pairs are only made between components, and a component's nodes
    are counted, not paired. A component that nothing reaches and that leads to one other only counts as part of what stands
    above that one; one that leads nowhere and hangs on one other only has that one's ancestors and its nodes. So leaves
    make no pairs either."""
    with workspace(edges.sparkSession):
        known = components(edges)
        pairs = edges.select("src", "dst").distinct()
        names = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        names = cut(names)
        sizes = cut(names.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
        of = lambda c: names.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        condensed = pairs.join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        condensed = cut(condensed.distinct())
        one = lambda df, a, b: df.groupBy(a).agg(F.min(b).alias(b), F.max(b).alias("_last")).where(F.col(b) == F.col("_last")).select(a, b)
        tops = cut(one(condensed, "src", "dst").join(condensed.select(F.col("dst").alias("src")).distinct(), "src", "left_anti"))
        lower = condensed.join(tops.select("src"), "src", "left_anti")
        ends = cut(one(lower, "dst", "src").join(lower.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti"))
        hung = tops.join(sizes.withColumnRenamed("component", "src"), "src").groupBy(F.col("dst").alias("component")).agg(F.sum("n").alias("hung"))
        weights = cut(sizes.join(hung, "component", "left").select("component", "n", F.coalesce("hung", F.lit(0)).alias("hung")))
        reach = distances(lower.join(ends.select("dst"), "dst", "left_anti"))
        over = reach.join(weights.select(F.col("component").alias("src"), (F.col("n") + F.col("hung")).alias("w")), "src").groupBy(F.col("dst").alias("component")).agg(F.sum("w").alias("over"))
        inner = cut(weights.join(over, "component", "left").select("component", "n", (F.coalesce("over", F.lit(0)) + F.col("hung")).alias("above")))
        given = ends.join(inner.select(F.col("component").alias("src"), (F.col("above") + F.col("n")).alias("given")), "src").select(F.col("dst").alias("component"), "given")
        total = inner.join(given, "component", "left").select("component", (F.col("above") + F.coalesce("given", F.lit(0)) + F.col("n") - 1).alias("n_ancestors")).where("n_ancestors > 0")
        return keep(names.join(total, "component").select("node", "n_ancestors"))
