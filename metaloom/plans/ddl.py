"""Queries over DDL text. Each part row gives a script whose names, sizes and flags follow from its columns, so the SQL
states what the script means without reading it."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import ddl as D
from metaloom.plans.registry import add
from metaloom.sources.scratch import cut, new_dir

#: The script of a part, in SQL that both engines read; q is a single quote, nl a line feed.
_PIECES = (
    "'-- CREATE TABLE Fake (id int)' || nl || '/* CREATE TABLE Fake2 (id int) */' || nl",
    "'CREATE TABLE [dbo].[T' || k || '] (' || nl || '  [Id] int IDENTITY(1,1) NOT NULL,' || nl",
    "'  \"kind' || s || '\" \"nvarchar\" (' || s || ') DEFAULT ' || q || '--no, (' || brand || q || ',' || nl",
    "'  `Price` decimal(' || (10 + p_size) || ',2) NOT NULL CONSTRAINT df DEFAULT ((0)),' || nl",
    "'  email varchar(' || s || ') UNIQUE, other_id int REFERENCES shop.U' || k || '(Id) ON UPDATE CASCADE,' || nl",
    "'  CONSTRAINT pk' || k || ' PRIMARY KEY CLUSTERED ([Id] ASC, `Price` DESC), UNIQUE (\"kind' || s || '\"),' || nl",
    "'  CONSTRAINT ck CHECK (Price > (' || s || ')), KEY ix (email)' || nl || ')' || nl || 'GO' || nl",
    "'create table if not exists shop.U' || k || ' (Id int unsigned, Name text, No int)' || nl || 'GO' || nl",
    "'ALTER TABLE shop.U' || k || ' WITH CHECK ADD CONSTRAINT pu' || k || ' PRIMARY KEY (Id), CONSTRAINT fu' || k || ' FOREIGN KEY (No, Id) REFERENCES [dbo].[T' || k || '] (Id, Price) ON DELETE ' || act || nl || 'GO' || nl",
    "'CREATE ' || uni || 'INDEX ix' || k || ' ON [shop].[U' || k || '] ([No] DESC, Name)' || nl",
    "'CREATE OR ALTER VIEW shop.V' || k || ' (a) AS SELECT * FROM [dbo].[T' || k || '] t JOIN U' || k || ' u ON t.Id = u.Id JOIN #tmp x ON 1 = 1' || nl || 'GO' || nl",
    "'CREATE TRIGGER trA' || k || ' ON [dbo].[T' || k || '] AFTER INSERT, UPDATE AS RETURN' || nl || 'GO' || nl",
    "'CREATE TRIGGER trB' || k || ' BEFORE DELETE ON shop.U' || k || ' FOR EACH ROW' || nl || 'GO' || nl",
    "'CREATE OR REPLACE PROCEDURE [dbo].[P' || k || '] @id int, @name varchar(' || s || ') = ' || q || 'x' || q || ', @out int OUTPUT AS UPDATE T' || k || ' SET No = 1 EXEC Log' || (p_size % 7) || nl || 'GO' || nl",
    "'CREATE FUNCTION F' || k || ' (IN a int, OUT b varchar(' || s || '), c decimal(9,2)) RETURNS int AS RETURN 1' || nl",
    "'GO' || nl || 'INSERT INTO notes VALUES (' || q || 'CREATE TABLE Ghost (x int)' || q || ')' || nl",
    "CASE WHEN p_size % 5 = 0 THEN 'GO' || nl || 'CREATE TABLE shop.T' || k || ' (Id int, email text)' || nl ELSE '' END",
)
_FACTS = ("CAST(p_partkey AS string) AS k", "CAST(p_size AS string) AS s", "p_brand AS brand", "CASE WHEN p_size % 2 = 0 THEN 'SET NULL' ELSE 'CASCADE' END AS act", "CASE WHEN p_size % 3 = 0 THEN 'UNIQUE ' ELSE '' END AS uni", "chr(39) AS q", "chr(10) AS nl", "p_partkey", "p_size")
_SQL = f"WITH p AS (SELECT {', '.join(_FACTS)} FROM part) "


def texts(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").repartition(s.sparkContext.defaultParallelism, "p_partkey")  # a small file is one task's, its scripts are not
    return rows.selectExpr(*_FACTS).select(F.concat(F.lit("part"), "k").alias("source_file"), F.expr(" || ".join(_PIECES)).alias("text"))


def _each(*rows: str) -> str:
    """A SELECT for each row that a part's script yields; a row after ?? only comes from scripts of every fifth size."""
    return _SQL + " UNION ALL ".join(f"SELECT {r.removeprefix('??')} FROM p" + " WHERE p_size % 5 = 0" * r.startswith("??") for r in rows)


def parts(s, d):
    """All statements of the scripts, cut once."""
    return cut(D.statements(texts(s, d)))


def columns(found):
    return D.columns(found, D.indexes(found))


add("P01_comments", lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "'SELECT ' || chr(39) || p_name || '--x' || chr(39) || ' -- ' || p_type || chr(10) || '/* ' || p_brand || chr(10) || ' */FROM [a--b] WHERE a - b / c' AS sql").select("p_partkey", D.without_comments(F.col("sql")).alias("clean")), "SELECT p_partkey, 'SELECT ' || chr(39) || p_name || '--x' || chr(39) || ' ' || chr(10) || ' FROM [a--b] WHERE a - b / c' AS clean FROM part")
add("P02_P05_tables", lambda s, d: parts(s, d).where("origin = 'create'").groupBy("schema", "tbl", "line").agg(F.count_if(F.col("kind") == "column").alias("n_columns"), F.count(F.lit(1)).alias("n_clauses")), _each("'dbo' AS schema, 'T' || k AS tbl, 3 AS line, 5 AS n_columns, 9 AS n_clauses", "'shop', 'U' || k, 12, 3, 3", "??'shop', 'T' || k, 29, 2, 2"))
_COLUMN = "tbl, ordinal, name, raw_type, norm_type, max_length, precision, scale, is_nullable, is_pk, is_unique, is_identity, is_indexed, default_value, risk".split(", ")
add("P06_columns", lambda s, d: columns(parts(s, d)).select(*_COLUMN), _each(
    "'T' || k AS tbl, 0 AS ordinal, 'Id' AS name, 'int' AS raw_type, 'integer' AS norm_type, CAST(NULL AS INTEGER) AS max_length, CAST(NULL AS INTEGER) AS precision, CAST(NULL AS INTEGER) AS scale, false AS is_nullable, true AS is_pk, false AS is_unique, true AS is_identity, true AS is_indexed, '' AS default_value, CAST(NULL AS VARCHAR) AS risk",
    "'T' || k, 1, 'kind' || s, 'nvarchar (' || s || ')', 'string', p_size, NULL, NULL, true, false, true, false, false, q || '--no, (' || brand || q, NULL",
    "'T' || k, 2, 'Price', 'decimal(' || (10 + p_size) || ',2)', 'decimal', NULL, 10 + p_size, 2, false, true, false, false, true, '((0))', NULL",
    "'T' || k, 3, 'email', 'varchar(' || s || ')', 'string', p_size, NULL, NULL, true, false, true, false, false, '', 'medium'",
    "'T' || k, 4, 'other_id', 'int', 'integer', NULL, NULL, NULL, true, false, false, false, false, '', NULL",
    "'U' || k, 0, 'Id', 'int unsigned', 'integer', NULL, NULL, NULL, true, true, false, false, true, '', NULL",
    "'U' || k, 1, 'Name', 'text', 'string', NULL, NULL, NULL, true, false, false, false, true, '', 'low'",
    "'U' || k, 2, 'No', 'int', 'integer', NULL, NULL, NULL, true, false, false, false, true, '', NULL",
    "??'T' || k, 0, 'Id', 'int', 'integer', NULL, NULL, NULL, true, false, false, false, false, '', NULL",
    "??'T' || k, 1, 'email', 'text', 'string', NULL, NULL, NULL, true, false, false, false, false, '', 'medium'",
))
add("P07_P16_constraints", lambda s, d: D.constraints(parts(s, d)).drop("source_file", "schema"), _each("'T' || k AS tbl, 'pk' AS kind, 'pk' || k AS name, 'Id,Price' AS cols, '' AS \"check\"", "'T' || k, 'unique', '', 'kind' || s, ''", "'T' || k, 'check', 'ck', '', 'Price > (' || s || ')'", "'U' || k, 'pk', 'pu' || k, 'Id', ''"))
add("P08_P16_foreign_keys", lambda s, d: D.foreign_keys(parts(s, d)).drop("source_file", "schema"), _each("'T' || k AS tbl, '' AS name, 'other_id' AS cols, 'U' || k AS ref_tbl, 'Id' AS ref_cols, 'NO ACTION' AS on_delete, 'CASCADE' AS on_update", "'U' || k, 'fu' || k, 'No,Id', 'T' || k, 'Id,Price', act, 'NO ACTION'"))
add("P09_indexes", lambda s, d: D.indexes(texts(s, d)).drop("source_file", "schema"), _each("'ix' || k AS idx, 'U' || k AS tbl, 'No,Name' AS cols, p_size % 3 = 0 AS is_unique"))
add("P10_P13_views", lambda s, d: D.views(texts(s, d)).drop("source_file"), _each("'shop' AS schema, 'V' || k AS view, 'SELECT * FROM [dbo].[T' || k || '] t JOIN U' || k || ' u ON t.Id = u.Id JOIN #tmp x ON 1 = 1' AS definition, 'T' || k || ',U' || k AS sources"))
add("P15_triggers", lambda s, d: D.triggers(texts(s, d)).drop("source_file"), _each("'trA' || k AS trg, 'T' || k AS tbl, 'AFTER' AS timing, 'INSERT,UPDATE' AS events", "'trB' || k, 'U' || k, 'BEFORE', 'DELETE'"))
add("P11_P12_procedures", lambda s, d: D.parameters(D.procedures(texts(s, d)).drop("source_file")), _each("'dbo' AS schema, 'P' || k AS proc, 'PROCEDURE' AS proc_type, 0 AS pos, '@id' AS name, 'int' AS raw_type, 'IN' AS direction, '' AS default_value", "'dbo', 'P' || k, 'PROCEDURE', 1, '@name', 'varchar(' || s || ')', 'IN', q || 'x' || q", "'dbo', 'P' || k, 'PROCEDURE', 2, '@out', 'int', 'OUT', ''", "'dbo', 'F' || k, 'FUNCTION', 0, 'a', 'int', 'IN', ''", "'dbo', 'F' || k, 'FUNCTION', 1, 'b', 'varchar(' || s || ')', 'OUT', ''", "'dbo', 'F' || k, 'FUNCTION', 2, 'c', 'decimal(9,2)', 'IN', ''"))
add("A02_ddl_summary", lambda s, d: D.summary(texts(s, d)), "SELECT kind, CAST(count(*) * n + m * count(*) FILTER (p_size % 5 = 0) AS BIGINT) AS n FROM part, (VALUES ('table', 2, 1), ('column', 8, 2), ('constraint', 4, 0), ('foreign_key', 2, 0), ('index', 1, 0), ('view', 1, 0), ('procedure', 1, 0), ('function', 1, 0), ('trigger', 2, 0)) AS t(kind, n, m) GROUP BY kind, n, m")


#: Scripts that a written file holds: some 600 KB.
SCRIPTS = 256


def script_files(s, d):
    """Scripts as files in a folder, written and scanned. A file is read as one row, so it holds SCRIPTS scripts at most."""
    out = new_dir(s, "scripts")
    texts(s, d).select("text").write.option("maxRecordsPerFile", SCRIPTS).text(out)
    return D.table_clauses(D.scripts(s, out, "part-*")).where("kind = 'column' AND origin = 'create'").groupBy("schema").agg(F.count(F.lit(1)).alias("n_columns"), F.countDistinct("tbl").alias("n_tables"))


add("S02_S03_script_files", script_files, "SELECT 'dbo' AS schema, 5 * count(*) AS n_columns, count(*) AS n_tables FROM part UNION ALL SELECT 'shop', 3 * count(*) + 2 * count(*) FILTER (p_size % 5 = 0), count(*) + count(*) FILTER (p_size % 5 = 0) FROM part")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def catalog(s, d):
    """Columns of the tables by their schemas."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t in TABLES for i, f in enumerate(s.read.parquet(f"{d}/{t}.parquet").schema)]
    frame = s.createDataFrame(rows, "tbl string, ordinal int, name string, raw string")
    norm = F.when(F.col("raw").isin("bigint", "int"), "integer").when(F.col("raw") == "string", "string").when(F.col("raw") == "double", "decimal").when(F.col("raw").startswith("timestamp"), "datetime").when(F.col("raw").startswith("array"), "array").otherwise("unknown")
    return frame.select("tbl", "ordinal", "name", norm.alias("norm"))


_CAT = "SELECT table_name AS tbl, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'DOUBLE' THEN 'decimal' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type LIKE '%[]' THEN 'array' ELSE 'unknown' END AS norm FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
add("S04_K02_catalog", catalog, _CAT)
add("S04_J06_key_names", lambda s, d: catalog(s, d).withColumn("k", F.regexp_replace(F.regexp_replace("name", "^[a-z]_", ""), "(key|_id|id)$", "")).where("name RLIKE '(key|_id|id)$' AND k <> ''").withColumn("target", F.explode(F.array("k", F.concat("k", F.lit("s"))))).join(s.createDataFrame([(t,) for t in TABLES], "target string"), "target").where("tbl <> target").select("tbl", "name", "target"), f"WITH c AS ({_CAT}), k AS (SELECT tbl, name, regexp_replace(regexp_replace(name, '^[a-z]_', ''), '(key|_id|id)$', '') AS k FROM c WHERE regexp_matches(name, '(key|_id|id)$')) SELECT DISTINCT k.tbl, k.name, t.tbl AS target FROM k JOIN (SELECT DISTINCT tbl FROM c) t ON t.tbl = k.k OR t.tbl = k.k || 's' WHERE k.tbl <> t.tbl AND k.k <> ''")
