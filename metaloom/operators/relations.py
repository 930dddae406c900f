"""Relationship inference: declared keys, names, views, inverses; resolved once by confidence and pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.scalar import confidence_rank


def known_tables(columns: DataFrame) -> DataFrame:
    return columns.select(F.col("tbl").alias("known"), F.lower("tbl").alias("k")).distinct()


def fk_edges(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """Keys to known tables; one_to_one if the key's single column is the single primary key column."""
    pk = columns.where("is_pk").groupBy("tbl").agg(F.count(F.lit(1)).alias("n_pk"), F.min(F.lower("name")).alias("pk"))
    key = fks.groupBy("tbl", "fk", "ref_tbl").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "col"))), lambda x: x.col), ",").alias("cols"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref_col"))), lambda x: x.ref_col), ",").alias("ref_cols"))
    known = key.join(known_tables(columns), F.lower("ref_tbl") == F.col("k")).join(pk, "tbl", "left")
    one = (F.col("n") == 1) & (F.col("n_pk") == 1) & (F.lower("cols") == F.col("pk"))
    kind = F.when(F.coalesce(one, F.lit(False)), "one_to_one").otherwise("many_to_one")
    return known.select("tbl", F.col("known").alias("target"), "cols", "ref_cols", kind.alias("kind"), (F.lower("tbl") == F.lower("ref_tbl")).alias("self_ref"))


def column_kinds(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """J02, X13."""
    used = fks.select("tbl", F.col("col").alias("name"), F.lit(True).alias("hit")).distinct()
    return columns.join(used, ["tbl", "name"], "left").select("tbl", "name", F.when(F.col("hit"), "foreign_key").when(F.col("norm_type").isin("json", "bytes"), "embedded").otherwise("primitive").alias("kind"))


def view_edges(views: DataFrame, columns: DataFrame) -> DataFrame:
    """A view's source is a table, else a view, else dangling."""
    tables = columns.select(F.col("tbl").alias("source"), F.lit(True).alias("is_table")).distinct()
    others = views.select(F.col("view").alias("source"), F.lit(True).alias("is_view")).distinct()
    return views.join(tables, "source", "left").join(others, "source", "left").select("view", "source", F.when(F.col("is_table"), "view_reads").when(F.col("is_view"), "view_reads_view").otherwise("dangling").alias("edge"))


def by_naming(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """A column XId points at table X or Xs (names without case), not its own table, no pair that a key joins."""
    base = F.regexp_extract("name", "(?i)^(.+?)_?id$", 1)
    cand = columns.withColumn("base", F.lower(base)).where("base <> ''").select("tbl", "name", F.explode(F.array("base", F.concat("base", F.lit("s")))).alias("k"))
    hit = cand.join(known_tables(columns), "k").where(F.lower("tbl") != F.col("k")).select("tbl", F.col("known").alias("target"), F.col("name").alias("col"))
    joined = fks.select(F.lower("tbl").alias("a"), F.lower("ref_tbl").alias("b")).distinct()
    return hit.join(joined, (F.lower("tbl") == F.col("a")) & (F.lower("target") == F.col("b")), "left_anti")


def view_pairs(views: DataFrame, fks: DataFrame) -> DataFrame:
    """Sources of one view in order, without pairs that a key joins in that direction."""
    a = views.select("view", F.col("source").alias("tbl"), F.col("pos").alias("p"))
    b = views.select("view", F.col("source").alias("target"), F.col("pos").alias("q"))
    pairs = a.join(b, "view").where((F.col("p") < F.col("q")) & (F.lower("tbl") != F.lower("target"))).select("tbl", "target").distinct()
    joined = fks.select(F.lower("tbl").alias("x"), F.lower("ref_tbl").alias("y")).distinct()
    return pairs.join(joined, (F.lower("tbl") == F.col("x")) & (F.lower("target") == F.col("y")), "left_anti")


def _candidates(base: Column) -> Column:
    cap = lambda tail: F.concat(F.upper(F.substring(base, 1, 1)), tail(F.substring(base, 2, 10_000)))
    return F.array(base, cap(F.lower), cap(lambda x: x))


def by_suffix(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """A field XId, X_id or XID points at entity X: as written, capitalised, or first letter upper; first that exists."""
    base = F.regexp_extract("field", "^(.+?)(?:Id|_id|ID)$", 1)
    cand = fields.withColumn("base", base).where("base <> '' AND NOT is_nav").select("entity", "field", F.posexplode(_candidates(F.col("base"))).alias("p", "target"))
    hit = cand.join(entities.select(F.col("entity").alias("target")).distinct(), "target").where("entity <> target")
    return hit.groupBy("entity", "field").agg(F.min_by("target", "p").alias("target"))


def inverses(rels: DataFrame) -> DataFrame:
    """many_to_one A to B without a B to A of the same field gives one_to_many B to A."""
    m = rels.where("kind = 'many_to_one'").select(F.col("target").alias("source"), F.col("source").alias("target"), "via").distinct()
    return m.join(rels.select("source", "target", "via"), ["source", "target", "via"], "left_anti").withColumn("kind", F.lit("one_to_many"))


def cross_domain(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Both aggregates known and different."""
    agg = lambda c: entities.select(F.col("entity").alias(c), F.col("aggregate").alias(f"{c}_agg"))
    both = rels.join(agg("source"), "source", "left").join(agg("target"), "target", "left")
    return both.select("source", "target", "via", F.coalesce((F.col("source_agg") != F.col("target_agg")) & (F.col("source_agg") != "") & (F.col("target_agg") != ""), F.lit(False)).alias("is_cross"))


def best(rels: DataFrame) -> DataFrame:
    """For each (source, target, kind) the row of the highest confidence, the earliest of equals."""
    w = Window.partitionBy("source", "target", "kind").orderBy(F.desc(confidence_rank(F.col("confidence"))), "pos")
    return rels.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def relationships(columns: DataFrame, fks: DataFrame, views: DataFrame) -> DataFrame:
    """Keys HIGH, view pairs MEDIUM, names LOW; for each pair the best, the earliest pass of equals."""
    passes = [(1, "HIGH", fk_edges(fks, columns).select("tbl", "target")), (3, "MEDIUM", view_pairs(views, fks)), (4, "LOW", by_naming(columns, fks).select("tbl", "target"))]
    every = None
    for n, conf, df in passes:
        part = df.select("tbl", "target", F.lit(conf).alias("confidence"), F.lit(n).alias("pass_no"))
        every = part if every is None else every.union(part)
    w = Window.partitionBy(F.lower("tbl"), F.lower("target")).orderBy("pass_no", "tbl", "target")
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("tbl", "target", "confidence", "pass_no")


def inclusion(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Rows of child without a parent row, counted: n_rows, n_orphans."""
    keys = parent.select(F.col(parent_col).alias("k"), F.lit(1).alias("hit")).distinct()
    per = child.groupBy(F.col(child_col).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k IS NOT NULL")
    return per.join(keys, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
