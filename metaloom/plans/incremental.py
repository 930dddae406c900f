"""Queries of the incremental cache, reports and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators import ddl as D
from metaloom.operators import governance as G
from metaloom.operators import report as RP
from metaloom.operators.report import markdown_table
from metaloom.plans import ddl
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import add
from metaloom.sources.scratch import cut, new_dir
from metaloom.streaming import cache as K
from metaloom.streaming import incremental as I


def pages(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), "text", "lang")


add("S12_cache_keys", lambda s, d: I.keyed(pages(s, d)).groupBy("lang").agg(F.countDistinct("key").alias("n_keys")), "SELECT lang, count(DISTINCT substring(sha256(text), 1, 24)) AS n_keys FROM documents GROUP BY lang")
add("S12_hit_rate", lambda s, d: I.hit_rate(pages(s, d), I.keyed(pages(s, d)).where("lang = 'en'")), "WITH k AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en'), c AS (SELECT count(*) AS n_files, count(*) FILTER (sha256(text) IN (SELECT h FROM k)) AS n_hits FROM documents) SELECT n_files, n_hits, CAST(round(n_hits / n_files, 3) AS DOUBLE) AS hit_rate FROM c")
add("S12_fresh", lambda s, d: I.fresh(pages(s, d), I.keyed(pages(s, d)).where("lang = 'en'")).agg(F.count(F.lit(1)).alias("n")), "SELECT count(DISTINCT text) AS n FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
add("K05_report", lambda s, d: markdown_table(G.table_profile(frame(s, d, "fx_columns")).select("tbl", "n", "has_pk"), ["tbl", "n", "has_pk"], ["tbl"]), f"{cte('fx_columns')}, t AS (SELECT tbl, count(*) AS n, bool_or(is_pk) AS p FROM fx_columns GROUP BY tbl) SELECT '| tbl | n | has_pk |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || tbl || ' | ' || n || ' | ' || CASE WHEN p THEN 'true' ELSE 'false' END || ' |', chr(10) ORDER BY tbl) AS markdown FROM t")
add("K05_report_lines", lambda s, d: RP.markdown_lines(G.table_profile(frame(s, d, "fx_columns")).select("tbl", "n", "has_pk"), ["tbl", "n", "has_pk"], ["tbl"]), f"{cte('fx_columns')}, t AS (SELECT tbl, count(*) AS n, bool_or(is_pk) AS p FROM fx_columns GROUP BY tbl) SELECT 0 AS no, '| tbl | n | has_pk |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY tbl) + 1, '| ' || tbl || ' | ' || n || ' | ' || CASE WHEN p THEN 'true' ELSE 'false' END || ' |' FROM t")


def model_documents(s, d):
    """The nested model of the part scripts, written as sorted parts and read again."""
    found, out = ddl.parts(s, d), new_dir(s, "model")
    model = RP.model_documents(ddl.columns(found), D.foreign_keys(found))
    manifest = RP.write_documents(model, out, ["source_file", "schema", "tbl"])
    back = RP.read_documents(s, out, "source_file string, schema string, tbl string, fields array<struct<ordinal: int, name: string, is_pk: boolean>>, keys array<struct<name: string, ref_tbl: string>>")
    rows = back.select("schema", "tbl", F.size("fields").alias("n_fields"), F.element_at("fields", 1)["name"].alias("first_field"), F.size(F.filter("fields", lambda f: f["is_pk"])).alias("n_keys"), F.concat_ws(",", F.transform("keys", lambda k: k["ref_tbl"])).alias("refs"))
    total = manifest.select(F.lit("").alias("schema"), F.lit("").alias("tbl"), F.col("n").cast("int").alias("n_fields"), F.lit("").alias("first_field"), F.lit(0).alias("n_keys"), F.lit("").alias("refs"))
    return rows.union(total.groupBy("schema", "tbl", "first_field", "n_keys", "refs").agg(F.sum("n_fields").cast("int").alias("n_fields")).select(*rows.columns))


_MODEL = "SELECT 'dbo' AS schema, 'T' || p_partkey AS tbl, 5 AS n_fields, 'Id' AS first_field, 2 AS n_keys, 'U' || p_partkey AS refs FROM part UNION ALL SELECT 'shop', 'U' || p_partkey, 3, 'Id', 1, 'T' || p_partkey FROM part UNION ALL SELECT 'shop', 'T' || p_partkey, 2, 'Id', 0, '' FROM part WHERE p_size % 5 = 0"
add("K03_model_document", model_documents, f"{_MODEL} UNION ALL SELECT '', '', CAST(count(*) AS INTEGER), '', 0, '' FROM ({_MODEL})")

_LONG = "[a-z]{9,}"


def cache_rounds(s, d):
    """What four runs over documents add and give: English only, all, all again, all for a new version; then a base."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_file"), "text", "lang")
    words = lambda df: df.select("source_file", F.explode(F.regexp_extract_all("text", F.lit(_LONG), F.lit(0))).alias("word"))
    folder, out = new_dir(s, "cache"), []
    for step, files, version in (("1 en", docs.where("lang = 'en'"), "1"), ("2 all", docs, "1"), ("3 again", docs, "1"), ("4 changed", docs, "2")):
        before = len(K.generations(s, folder))
        got = K.refresh(files, folder, words, version).agg(F.count(F.lit(1)).alias("n_rows"))
        after = K.generations(s, folder)
        added = K.entries(s, folder).where(F.col("generation").isin(after[before:])).agg(F.count(F.lit(1)).alias("n_new"))
        out.append(got.join(added).select(F.lit(step).alias("step"), "n_rows", "n_new"))  # one row each
    out = [cut(o) for o in out]
    K.compact(s, folder, "2", "word string")
    base = K.rows(s, folder, "2", "word string").agg(F.count(F.lit(1)).alias("n_rows"))
    out.append(base.join(K.entries(s, folder).agg(F.count(F.lit(1)).alias("n_new"))).select(F.lit("5 base").alias("step"), "n_rows", "n_new"))
    return reduce(DataFrame.unionByName, out)


add("S12_cache_rounds", cache_rounds, f"""WITH t AS (SELECT coalesce(text, '') AS text, lang = 'en' AS en, len(regexp_extract_all(coalesce(text, ''), '{_LONG}')) AS n FROM documents), u AS (SELECT text, bool_or(coalesce(en, false)) AS en, any_value(n) AS n FROM t GROUP BY text)
  SELECT '1 en' AS step, (SELECT CAST(sum(n) AS BIGINT) FROM t WHERE en) AS n_rows, (SELECT count(*) FROM u WHERE en) AS n_new UNION ALL SELECT '2 all', (SELECT CAST(sum(n) AS BIGINT) FROM t), (SELECT count(*) FROM u WHERE NOT en) UNION ALL SELECT '3 again', (SELECT CAST(sum(n) AS BIGINT) FROM t), 0
  UNION ALL SELECT '4 changed', (SELECT CAST(sum(n) AS BIGINT) FROM t), (SELECT count(*) FROM u) UNION ALL SELECT '5 base', (SELECT CAST(sum(n) AS BIGINT) FROM u), (SELECT count(*) FROM u)""")
