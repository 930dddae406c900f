"""The property graph of a catalog: a vertex table with dense ids, and typed edges between ids.

Nodes and edges are projections of statements() rows and procedure facts. A key that several scripts define keeps the
properties of the first one by script and line; an end that nothing defines becomes a node of its own, marked dangling, so
that every edge has both. Ids are places in the order of keys (ranks.numbered), so they need no one-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators import ddl as D
from metaloom.operators import procedures as P
from metaloom.operators.lineage import access
from metaloom.operators.ranks import numbered
from metaloom.sources.scratch import cut


def _key(kind: str, *names: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), *[F.col(n) if i == 0 else F.concat(F.lit("."), n) for i, n in enumerate(names)])


def catalog_edges(found: DataFrame) -> DataFrame:
    """(src, dst, edge, detail) of a catalog's statements; src and dst are keys like TABLE:name and COLUMN:table.name."""
    columns, fks, views = D.columns(found), D.foreign_keys(found), D.views(found)
    procs, indexes = D.procedures(found), D.indexes(found)
    row = lambda df, src, dst, edge, detail="": df.select(src.alias("src"), dst.alias("dst"), F.lit(edge).alias("edge"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    table, column = _key("TABLE", "tbl"), _key("COLUMN", "tbl", "name")
    pairs = fks.select("tbl", "ref_tbl", "name", F.explode(F.arrays_zip(F.split("cols", ",").alias("c"), F.split("ref_cols", ",").alias("r"))).alias("z")).where("z.c IS NOT NULL AND z.r <> ''")
    refs = pairs.select(F.concat(F.lit("COLUMN:"), "tbl", F.lit("."), "z.c").alias("a"), F.concat(F.lit("COLUMN:"), "ref_tbl", F.lit("."), "z.r").alias("b"), "name")
    used = access(P.tables(procs)).withColumn("edge", F.when(F.col("kind") == "read", "PROC_READS").when(F.col("kind") == "write", "PROC_WRITES").otherwise("PROC_DELETES"))
    covers = indexes.select("idx", "tbl", F.posexplode(F.split("cols", ",")).alias("at", "name"))
    each = [
        row(columns, table, column, "HAS_COLUMN", F.col("ordinal").cast("string")),
        row(columns.where("is_pk"), table, column, "PK_COLUMN"),
        row(fks, table, _key("TABLE", "ref_tbl"), "FK_TO", F.concat_ws("|", "name", "on_delete", "on_update")),
        row(refs, F.col("a"), F.col("b"), "REFERENCES", F.col("name")),
        row(_constraints(found), table, F.col("key"), "HAS_CONSTRAINT"),
        row(views.select("view", F.explode(F.split("sources", ",")).alias("tbl")).where("tbl <> ''"), _key("VIEW", "view"), table, "VIEW_READS"),
        used.select(_key("PROCEDURE", "proc").alias("src"), table.alias("dst"), "edge", F.lit("").alias("detail")),
        row(P.calls(procs), _key("PROCEDURE", "caller"), _key("PROCEDURE", "callee"), "PROC_CALLS"),
        row(indexes, table, _key("INDEX", "idx"), "INDEXED_BY", F.when(F.col("is_unique"), "unique").otherwise("")),
        row(covers, _key("INDEX", "idx"), column, "INDEX_COVERS", F.col("at").cast("string")),
    ]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.distinct()


def _constraints(found: DataFrame) -> DataFrame:
    """(source_file, schema, tbl, line, key, detail): one primary key a table, UNIQUE and CHECK clauses by their place."""
    made = found.where("origin = 'create'")
    keys = D.columns(found).where("is_pk").groupBy("source_file", "schema", "tbl").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), ",").alias("detail"))  # a table's key columns
    pk = keys.withColumn("key", F.concat(F.lit("CONSTRAINT:PK_"), "tbl"))
    other = D.constraints(found.where("kind IN ('unique', 'check')")).withColumn("detail", F.when(F.col("kind") == "check", F.col("check")).otherwise(F.col("cols")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source_file", "schema", "tbl", "kind").orderBy("detail")) - 1  # a table's constraints
    other = other.withColumn("n", place).withColumn("key", F.concat(F.when(F.col("kind") == "check", "CONSTRAINT:CHK_").otherwise("CONSTRAINT:UQ_"), "tbl", F.lit("_"), F.col("n").cast("string")))
    shape = ("source_file", "schema", "tbl", "key", "detail")
    lines = made.groupBy("source_file", "schema", "tbl").agg(F.min("line").alias("line"))
    return pk.select(*shape).union(other.select(*shape)).join(lines, ["source_file", "schema", "tbl"], "left")


def catalog_nodes(found: DataFrame) -> DataFrame:
    """(key, node_type, name, schema, detail): the first definition of each."""
    made = found.where("origin = 'create'")
    first = F.struct("source_file", "line")
    tables = made.select("source_file", "line", "schema", _key("TABLE", "tbl").alias("key"), F.lit("TABLE").alias("node_type"), F.col("tbl").alias("name"), F.lit("").alias("detail"))
    lines = made.groupBy("source_file", "schema", "tbl").agg(F.min("line").alias("line"))
    columns = D.columns(found).join(lines, ["source_file", "schema", "tbl"]).select("source_file", "line", "schema", _key("COLUMN", "tbl", "name").alias("key"), F.lit("COLUMN").alias("node_type"), "name", F.concat_ws("|", "norm_type", F.col("is_nullable").cast("string"), F.col("is_pk").cast("string")).alias("detail"))
    cons = _constraints(found).select("source_file", "line", "schema", "key", F.lit("CONSTRAINT").alias("node_type"), F.substring("key", 12, 1000).alias("name"), "detail")
    rest = found.where("kind = 'statement' AND origin IN ('view', 'procedure', 'index')").withColumn("own", F.when(F.col("origin") == "index", F.col("constraint")).otherwise(F.col("tbl")))
    rest = rest.select("source_file", "line", "schema", F.concat(F.upper("origin"), F.lit(":"), "own").alias("key"), F.upper("origin").alias("node_type"), F.col("own").alias("name"), F.lit("").alias("detail"))
    every = tables.unionByName(columns).unionByName(cons).unionByName(rest)
    return every.groupBy("key").agg(F.min_by(F.struct("node_type", "name", "schema", "detail"), first).alias("x")).select("key", "x.*")


def property_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, key, node_type, name, schema, detail, dangling; edges: src_id, dst_id, edge, detail)."""
    edges = cut(catalog_edges(found))
    ends = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    known = catalog_nodes(found)
    every = known.join(ends, "key", "full")
    name = F.regexp_extract("key", r"^[A-Z]+:(?:.*\.)?(.*)$", 1)
    nodes = every.select("key", F.coalesce("node_type", F.split_part("key", F.lit(":"), F.lit(1))).alias("node_type"), F.coalesce("name", name).alias("name"), "schema", "detail", F.col("node_type").isNull().alias("dangling"))
    nodes = cut(numbered(nodes, [F.col("key")]))
    of = lambda c: nodes.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    return nodes, edges.join(of("src"), "src").join(of("dst"), "dst").select("src_id", "dst_id", "edge", "detail")
