"""Lineage of tables, views and procedures: the edge union, impact of each table, duplicate readers, totals.

Everything is in long form, a row per edge or per table and consumer, so a table with very many consumers is never one
row; counts are partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators.paths import chains

ROLES = ("read_by", "written_by", "deleted_by", "fk_parents", "fk_children")


def access(facts: DataFrame) -> DataFrame:
    """(proc, tbl, kind) of procedure facts with comma-joined reads, writes and deletes."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.split(F.col(c), ",").alias("tables")) for kind, c in (("read", "reads"), ("write", "writes"), ("delete", "deletes"))])
    return facts.select("proc", F.explode(each).alias("a")).select("proc", "a.kind", F.explode("a.tables").alias("tbl")).where("tbl <> ''").select("proc", "tbl", "kind")


def edges(tables: DataFrame, views: DataFrame, facts: DataFrame, fks: DataFrame) -> DataFrame:
    """(src, dst, edge, via) of views (view, source), procedures and keys (tbl, ref_tbl, cols). A view's source is a
    table, else a view, else left out. All sides grow with the catalog, so none is broadcast."""
    known = tables.select(F.col("tbl").alias("source"), F.lit(True).alias("is_table")).distinct()
    others = views.select(F.col("view").alias("source"), F.lit(True).alias("is_view")).distinct()
    v = views.join(known.hint("merge"), "source", "left").join(others.hint("merge"), "source", "left").where("is_table OR is_view")
    view = F.concat(F.lit("VIEW:"), F.col("view"))
    of_views = v.select(F.when(F.col("is_table"), F.col("source")).otherwise(F.concat(F.lit("VIEW:"), "source")).alias("src"), view.alias("dst"), F.when(F.col("is_table"), "view_reads").otherwise("view_reads_view").alias("edge"), F.col("view").alias("via"))
    proc = F.concat(F.lit("PROC:"), F.col("proc"))
    reads = F.col("kind") == "read"
    of_procs = access(facts).select(F.when(reads, F.col("tbl")).otherwise(proc).alias("src"), F.when(reads, proc).otherwise(F.col("tbl")).alias("dst"), F.when(reads, "proc_reads").when(F.col("kind") == "write", "proc_writes").otherwise("proc_deletes").alias("edge"), F.col("proc").alias("via"))
    return of_views.union(of_procs).union(fks.select("tbl", "ref_tbl", F.lit("fk_reference"), "cols"))


def impact(tables: DataFrame, edges_: DataFrame) -> DataFrame:
    """(tbl, role, other, times) for each known table: who reads, writes and deletes, and parents and children by keys."""
    e = F.col("edge")
    way = F.when(e.isin("view_reads", "proc_reads"), F.array(F.struct(F.col("src").alias("tbl"), F.lit("read_by").alias("role"), F.col("dst").alias("other"))))
    way = way.when(e == "proc_writes", F.array(F.struct(F.col("dst").alias("tbl"), F.lit("written_by").alias("role"), F.col("src").alias("other"))))
    way = way.when(e == "proc_deletes", F.array(F.struct(F.col("dst").alias("tbl"), F.lit("deleted_by").alias("role"), F.col("src").alias("other"))))
    way = way.when(e == "fk_reference", F.array(F.struct(F.col("src").alias("tbl"), F.lit("fk_parents").alias("role"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("tbl"), F.lit("fk_children").alias("role"), F.col("src").alias("other"))))
    rows = edges_.select(F.explode(way).alias("x")).select("x.*")
    return rows.join(tables.select("tbl").distinct(), "tbl", "left_semi").groupBy("tbl", "role", "other").agg(F.count(F.lit(1)).alias("times"))


def impact_counts(tables: DataFrame, edges_: DataFrame) -> DataFrame:
    """A row per known table, also without any edge: distinct others by role and the distinct consumers of reads
    and writes."""
    rows = impact(tables, edges_)
    roles = rows.groupBy("tbl").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES])
    users = rows.where("role IN ('read_by', 'written_by')").select("tbl", "other").distinct().groupBy("tbl").agg(F.count(F.lit(1)).alias("total_consumers"))
    out = tables.select("tbl").distinct().join(roles, "tbl", "left").join(users, "tbl", "left")
    return out.select("tbl", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*(f"n_{r}" for r in ROLES), "total_consumers")])


def duplicate_readers(edges_: DataFrame, least: int = 3) -> DataFrame:
    """(tbl, reader, n_readers) of tables that several procedures touch or views read."""
    e = F.col("edge")
    rows = edges_.where(e.isin("view_reads", "proc_reads")).select(F.col("src").alias("tbl"), F.col("dst").alias("reader")).union(edges_.where(e.isin("proc_writes", "proc_deletes")).select("dst", "src")).distinct()
    many = rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("n_readers")).where(F.col("n_readers") >= least)
    return rows.join(many, "tbl")


WRITES = ("proc_writes", "proc_deletes")
_KINDS = ("view_reads", "view_reads_view", "proc_reads", "proc_writes", "proc_deletes", "fk_reference")


def lineage_chains(tables: DataFrame, edges_: DataFrame, **how) -> DataFrame:
    """G02 over G01's edges, from the first tables by name. Of parallel edges the last kind counts: deletes before writes."""
    kinds = F.array(*map(F.lit, _KINDS))
    typed = edges_.select("src", "dst", F.col("edge").alias("kind"), F.array_position(kinds, F.col("edge")).alias("pos"))
    return chains(typed, writes=WRITES, first=tables.select(F.col("tbl").alias("node")), **how)


def totals(tables: DataFrame, views: DataFrame, procs: DataFrame, edges_: DataFrame, chains_: DataFrame | None = None) -> DataFrame:
    """(what, n): edges by kind, tables, views and procedures, and chains."""
    each = [chains_.select(F.lit("chains").alias("what"))] if chains_ is not None else []
    each += [edges_.select(F.col("edge").alias("what")), tables.select("tbl").distinct().select(F.lit("tables")), views.select("view").distinct().select(F.lit("views")), procs.select("proc").distinct().select(F.lit("procedures"))]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
