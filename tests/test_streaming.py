"""The stream over a folder of scripts extracts each content once."""

from metaloom.operators import ddl
from metaloom.streaming.incremental import follow


def test_dropped_scripts_are_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sql").write_text("CREATE TABLE a (x int, y int)")
    run = lambda: follow(spark, str(folder), ddl.table_clauses, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "b.sql").write_text("CREATE TABLE b (z int)")
    (folder / "copy.sql").write_text("CREATE TABLE a (x int, y int)")
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.tbl, r.clause) for r in rows) == [("a", "x int"), ("a", "y int"), ("b", "z int")]
