"""Passes composed of others: relations found in code and in a catalog, enrichment, flow traces, injections, type
resolution, adapter choice, and catalogs in and out of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.functions.scalar import confidence_rank
from metaloom.operators import relations as R
from metaloom.sources.scratch import cut, keep, workspace

EXTERNAL = ("Card", "AspNetUser", "IdentityUser")
#: Adapters with what a project needs for them, in their order; the first is the fallback.
ADAPTERS = (
    ("ef_core", "language", ("csharp",)),
    ("spring_jpa", "language", ("java", "kotlin")),
    ("django", "language", ("python",)),
    ("nodejs", "language", ("typescript", "javascript")),
    ("sqlserver", "db", ("sqlserver",)),
    ("postgresql", "db", ("postgresql",)),
    ("mysql", "db", ("mysql",)),
    ("sqlite", "db", ("sqlite",)),
)


def relation_kind(text: Column) -> Column:
    """A relation kind from free words; one_to_many without any."""
    v = F.lower(text)
    has = lambda *words: v.rlike("|".join(words))
    return F.when(has("many_to_many", "m2m"), "many_to_many").when(has("one_to_many", "1_to_n"), "one_to_many").when(has("many_to_one", "n_to_1"), "many_to_one").when(has("one_to_one", "1_to_1"), "one_to_one").when(has("embeds", "owned"), "embeds").when(has("references", "cross"), "references").otherwise("one_to_many")


def confidence_level(text: Column) -> Column:
    """X14."""
    v = F.upper(text)
    return F.when(v.isin("HIGH", "1.0", "0.9", "0.85"), "HIGH").when(v.isin("MEDIUM", "0.7", "0.65", "0.6"), "MEDIUM").otherwise("LOW")


def endpoint_style(text: Column) -> Column:
    """X14."""
    v = F.lower(text)
    return F.when(v.contains("minimal"), "minimal_api").when(v.contains("razor"), "razor_page").when(v.contains("graphql"), "graphql").when(v.contains("grpc"), "grpc").otherwise("rest_controller")


def ordered_union(*lists: Column) -> Column:
    """The distinct items of several arrays in the order in which they first come."""
    return F.array_distinct(F.concat(*lists))


def _marked(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """rels with cross_domain: both aggregates known and different."""
    known = entities.where("coalesce(aggregate, '') <> ''").groupBy("entity").agg(F.min("aggregate").alias("a"))
    side = lambda c: known.select(F.col("entity").alias(c), F.col("a").alias(f"_{c}"))
    both = rels.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return both.withColumn("cross_domain", F.coalesce(F.col("_source") != F.col("_target"), F.lit(False))).drop("_source", "_target")


def enriched(rels: DataFrame, fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Rels (source, target, kind, via, confidence) and those that key names (MEDIUM) and inverses add, each
    (source, target, via) once, all with cross_domain."""
    named = R.by_suffix(fields, entities).select(F.col("entity").alias("source"), "target", F.lit("many_to_one").alias("kind"), F.col("field").alias("via"), F.lit("MEDIUM").alias("confidence"), F.lit(1).alias("pass_no"))
    back = R.inverses(rels).select("source", "target", "kind", "via", F.lit("MEDIUM").alias("confidence"), F.lit(2).alias("pass_no"))
    have = rels.select("source", "target", "kind", "via", "confidence", F.lit(0).alias("pass_no"))
    key = ["source", "target", "via"]
    fresh = named.union(back).join(rels.select(*key).distinct(), key, "left_anti")
    first = fresh.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("pass_no"))).where("rn = 1").drop("rn")
    return _marked(have.unionByName(first), entities)


def code_relations(configured: DataFrame, fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of code in five passes: configuration (source, target, kind, via), collections, key fields (to the
    navigation of that target if there is one), owned value objects, and single navigations that no earlier pass covers.
    fields: entity, name, category, target; entities: entity, aggregate, is_value. Of (source, target, kind) the most
    confident is kept, the earliest pass of equals."""
    known = entities.select(F.col("entity").alias("target"), "is_value").distinct()
    row = lambda df, kind, via, conf, n: df.select("source", "target", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), via.alias("via"), F.lit(conf).alias("confidence") if isinstance(conf, str) else conf.alias("confidence"), F.lit(n).alias("pass_no"))
    f = fields.select(F.col("entity").alias("source"), "name", "category", "target")
    one = row(configured, F.col("kind"), F.col("via"), "HIGH", 1)
    lists = row(f.where("category = 'collection'").join(known.select("target").distinct(), "target", "left_semi"), "one_to_many", F.col("name"), "HIGH", 2)
    navs = f.where("category = 'navigation'").groupBy("source", "target").agg(F.max("name").alias("nav"))
    keys = f.where("category = 'foreign_key'").join(navs, ["source", "target"], "left").join(known.select("target", F.lit(True).alias("known")).distinct(), "target", "left")
    keys = row(keys.where(F.col("known").isNotNull() | ~F.col("target").isin(*EXTERNAL)), F.when(F.col("known"), "many_to_one").otherwise("references"), F.when(F.col("known"), F.coalesce("nav", "name")).otherwise(F.col("name")), F.when(F.col("known"), "HIGH").otherwise("MEDIUM"), 3)
    owned = row(f.where("category = 'navigation'").join(known.where("is_value").select("target"), "target", "left_semi"), "embeds_value_object", F.col("name"), "HIGH", 4)
    sure = one.union(lists).union(keys).union(owned)
    single = f.where("category = 'navigation'").join(known.select("target").distinct(), "target", "left_semi").join(sure.select("source", "target").distinct(), ["source", "target"], "left_anti")
    single = single.groupBy("source", "target").agg(F.min("name").alias("name"))
    every = sure.union(row(single, "references", F.col("name"), "MEDIUM", 5))
    w = Window.partitionBy("source", "target", "kind").orderBy(F.desc(confidence_rank(F.col("confidence"))), "pass_no", "via")
    return _marked(every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"), entities)


def catalog_relations(fks: DataFrame, rels: DataFrame, columns: DataFrame, views: DataFrame) -> DataFrame:
    """Keys (HIGH), the model's relations, pairs of view sources (MEDIUM) and names (LOW); of (source, target)
    without case the most confident, the earliest pass of equals."""
    keys = fks.select(F.col("tbl").alias("source"), F.col("ref_tbl").alias("target"), F.col("col").alias("via"), F.lit("HIGH").alias("confidence"), F.lit(1).alias("pass_no"))
    model = rels.select("source", "target", "via", "confidence", F.lit(2))
    inferred = R.view_pairs(views, fks).select("tbl", "target", F.lit(""), F.lit("MEDIUM"), F.lit(3))
    named = R.by_naming(columns, fks).select("tbl", "target", "col", F.lit("LOW"), F.lit(4))
    every = keys.union(model).union(inferred).union(named)
    w = Window.partitionBy(F.lower("source"), F.lower("target")).orderBy(F.desc(confidence_rank(F.col("confidence"))), "pass_no", "source", "via")
    first = every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.withColumns({"is_inferred": F.col("pass_no") >= 3, "is_self": F.lower("source") == F.lower("target")})


def relation_statistics(rels: DataFrame) -> DataFrame:
    """One row: all, keys, inferred, self references and each confidence."""
    c = F.col("confidence")
    return rels.agg(F.count(F.lit(1)).alias("n"), F.count_if((c == "HIGH") & ~F.col("is_inferred")).alias("n_keys"), F.count_if("is_inferred").alias("n_inferred"), F.count_if("is_self").alias("n_self"), *[F.count_if(c == level).alias(f"n_{level.lower()}") for level in ("HIGH", "MEDIUM", "LOW")])


LAYERS = ("api", "service", "repository", "entity", "value_object")


def traced(endpoints: DataFrame, handlers: DataFrame, fields: DataFrame, entities: DataFrame) -> DataFrame:
    """(flow, pos, layer, component): a flow per endpoint and per handler through services, repositories, entities and
    the value objects that they hold, and one step for each entity that no flow reaches."""
    listed = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")
    ends = endpoints.select(F.concat_ws(" ", "method", "path").alias("flow"), F.array(F.concat_ws(" ", "method", "path")).alias("api"), listed("services").alias("service"), listed("repos").alias("repository"), listed("entities").alias("entity"))
    hands = handlers.select("handler", F.array("handler"), F.array().cast("array<string>"), listed("repos"), listed("entities"))
    heads = ends.union(hands)
    steps = None
    for n, layer in enumerate(LAYERS[:4]):
        part = heads.select("flow", F.posexplode(layer).alias("i", "component")).select("flow", F.lit(n).alias("l"), "i", "component")
        steps = part if steps is None else steps.union(part)
    known = entities.select(F.col("entity").alias("component")).distinct()
    real = steps.where("l < 3").union(steps.where("l = 3").join(known, "component", "left_semi").select("flow", "l", "i", "component"))
    values = entities.where("kind = 'value_object'").select(F.col("entity").alias("held")).distinct()
    holds = fields.where("is_nav AND type NOT LIKE '%<%'").select(F.col("entity").alias("component"), F.col("type").alias("held")).join(values, "held", "left_semi").distinct()
    held = real.where("l = 3").join(holds, "component").groupBy("flow", "held").agg(F.min("i").alias("i")).select("flow", F.lit(4), "i", "held")
    every = real.union(held)
    w = Window.partitionBy("flow").orderBy("l", "i", "component")
    flows = every.select("flow", (F.row_number().over(w) - 1).alias("pos"), F.element_at(F.array(*map(F.lit, LAYERS)), F.col("l") + 1).alias("layer"), "component")
    gaps = entities.where("kind <> 'value_object'").select(F.col("entity").alias("component")).distinct().join(real.where("l = 3").select("component").distinct(), "component", "left_anti")
    return flows.union(gaps.select(F.concat(F.lit("gap:"), "component"), F.lit(0), F.lit("gap"), "component"))


def injections(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """(src, dst, kind): services and repositories that endpoints and handlers are given."""
    listed = lambda c: F.explode(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != ""))
    end = F.concat_ws(" ", "method", "path")
    return endpoints.select(end.alias("src"), listed("services").alias("dst"), F.lit("service").alias("kind")).union(endpoints.select(end, listed("repos"), F.lit("repository"))).union(handlers.select("handler", listed("repos"), F.lit("repository"))).distinct()


def resolved_names(uses: DataFrame, types: DataFrame, usings: DataFrame) -> DataFrame:
    """The full name of each used type (file, ns, type): one of the same namespace, else of a namespace that the file
    uses (the first by name), else as written. types: ns, name; usings: file, ns."""
    same = types.select("ns", F.col("name").alias("type"), F.concat_ws(".", "ns", "name").alias("own"))
    other = usings.select("file", F.col("ns").alias("used")).join(types.select(F.col("ns").alias("used"), F.col("name").alias("type")), "used").groupBy("file", "type").agg(F.min("used").alias("used"))
    out = uses.join(same, ["ns", "type"], "left").join(other, ["file", "type"], "left")
    return out.select("file", "type", F.coalesce(F.col("own"), F.when(F.col("used").isNotNull(), F.concat_ws(".", "used", "type")), F.col("type")).alias("full"))


def aliases(fields: DataFrame, entities: DataFrame, primitives: tuple[str, ...]) -> DataFrame:
    """(entity, property, type, is_known) of single navigations; unknown: neither an entity nor primitive."""
    known = entities.select(F.col("entity").alias("type"), F.lit(True).alias("hit")).distinct()
    nav = fields.where("is_nav AND type NOT LIKE '%<%'").select("entity", F.col("field").alias("property"), F.regexp_replace("type", r"\?$", "").alias("type"))
    return nav.join(known, "type", "left").select("entity", "property", "type", (F.col("hit").isNotNull() | F.col("type").isin(*primitives)).alias("is_known"))


def chosen_adapters(context: DataFrame) -> DataFrame:
    """Adapters that a project's languages and databases (kind, name) ask for; the first adapter where none does."""
    asked = F.array_compact(F.array(*[F.when((F.col("kind") == kind) & F.col("name").isin(*names), F.struct(F.lit(i).alias("place"), F.lit(a).alias("adapter"))) for i, (a, kind, names) in enumerate(ADAPTERS)]))
    found = context.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(asked)))).alias("a"))  # len(ADAPTERS) at most
    fallback = F.array(F.struct(F.lit(0).alias("place"), F.lit(ADAPTERS[0][0]).alias("adapter")))
    return found.select(F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(fallback)).alias("x")).select("x.place", "x.adapter")


def clusters(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """(aggregate, entities, internal, external): entities of each aggregate and relations that start in it."""
    e = entities.select("entity", F.coalesce("aggregate", F.lit("root")).alias("aggregate")).distinct()
    side = lambda c: e.select(F.col("entity").alias(c), F.col("aggregate").alias(f"{c}_a"))
    ties = rels.join(side("source"), "source").join(side("target"), "target").groupBy(F.col("source_a").alias("aggregate")).agg(F.count_if(F.col("source_a") == F.col("target_a")).alias("internal"), F.count_if(F.col("source_a") != F.col("target_a")).alias("external"))
    return e.groupBy("aggregate").agg(F.count(F.lit(1)).alias("entities")).join(ties, "aggregate", "left").na.fill(0, ["internal", "external"])


def save(rows: DataFrame, path: str, form: str = "json") -> None:
    """A relation as files of a folder, in json or parquet; tasks write their parts."""
    rows.write.mode("overwrite").format(form).save(path)


def load(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """A relation that save() wrote."""
    return spark.read.schema(schema).format(form).load(path)


def _sqlite(files: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """(path, *schema) of the rows that a SQLite file gives for each of its tables; files: path, content."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in f"path string, {schema}".split(",")]
    target = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(content)
                    tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
                    found = [(path, t, *r) for t in tables for r in rows(con, '"' + t.replace('"', '""') + '"')]
                finally:
                    con.close()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), target)], schema=target)

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def sqlite_columns(files: DataFrame) -> DataFrame:
    """(path, tbl, ordinal, name, raw_type, is_nullable, is_pk, default_value) of SQLite files (path, content), as
    spark.read.format("binaryFile") gives them: each is opened in a task, only its catalog is read."""
    return _sqlite(files, "tbl string, ordinal int, name string, raw_type string, is_nullable boolean, is_pk boolean, default_value string", lambda con, t: [(c[0], c[1], c[2] or "", not c[3] and not c[5], bool(c[5]), c[4]) for c in con.execute(f"PRAGMA table_info({t})")])


def sqlite_keys(files: DataFrame) -> DataFrame:
    """(path, tbl, no, col, ref_tbl, ref_col, on_delete, on_update) of SQLite files (path, content)."""
    return _sqlite(files, "tbl string, no int, col string, ref_tbl string, ref_col string, on_delete string, on_update string", lambda con, t: [(k[0], k[3], k[2], k[4], k[6], k[5]) for k in con.execute(f"PRAGMA foreign_key_list({t})")])


def resolved_aliases(names: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(name, resolved, is_cycle) of aliases (name, target), through chains of any length; a name that leads into a
    cycle resolves to null. Pointers double each round, so a chain of n takes log n rounds; what still points to an alias
    after as many rounds as the number of aliases needs is on its way round a cycle. Of several targets the least counts."""
    with workspace(names.sparkSession):
        now = cut(names.where("name IS NOT NULL").groupBy("name").agg(F.min("target").alias("to")))
        n = 1
        total = now.count()
        while n <= total:
            step = now.select(F.col("name").alias("to"), F.col("to").alias("next"))
            now = cut(now.join(step, "to", "left").select("name", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            left, n = now.where("moved").count(), 2 * n
            if rounds is not None:
                rounds.append(left)
            now = now.select("name", "to")
            if not left:
                break
        known = now.select(F.col("name").alias("to"), F.lit(True).alias("again"))
        return keep(now.join(known, "to", "left").select("name", F.when(F.col("again").isNull(), F.col("to")).alias("resolved"), F.col("again").isNotNull().alias("is_cycle")))
