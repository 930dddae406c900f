"""The extraction cache: what is read again and what is not, filters, lost runs and compaction."""

import os

from pyspark.sql import functions as F

from metaloom.streaming import cache as K

SHAPE = "source_file string, text string, key int"


def words(seen):
    def extract(df):
        seen.append(sorted(r.text for r in df.collect()))
        return df.select("source_file", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")

    return extract


def test_unchanged_contents_are_not_read_again(spark, tmp_path):
    folder, seen = str(tmp_path), []
    run = lambda rows, version="1", **how: sorted(map(tuple, K.refresh(spark.createDataFrame(rows, SHAPE), folder, words(seen), version, **how).collect()))
    first = [("a", "x y", 1), ("b", "x y", 2), ("c", None, 3), ("d", "", 4), ("a", "z", 5), ("a", "x y", 6)]
    told = [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "y")]
    assert run(first) == told and seen.pop() == ["", "x y", "z"]
    assert run(first) == told and seen.pop() == []
    assert K.generations(spark, folder) == ["step-00000001"]
    assert run([*first, ("e", "new", 7)]) == sorted([*told, ("e", "new")]) and seen.pop() == ["new"]
    assert run(first, "2") == told and seen.pop() == ["", "x y", "z"]
    assert run(first, "2", bits=32) == told and seen.pop() == []  # a full filter decides nothing
    os.makedirs(f"{folder}/step-00000009/rows")  # a lost run
    assert run([("f", "late", 8)], "2") == [("f", "late")] and seen.pop() == ["late"]
    assert K.compact(spark, folder, "2", "word string") == "base-00000010"
    assert K.generations(spark, folder) == ["base-00000010"] and K.compact(spark, folder, "2", "word string") is None
    assert run([*first, ("f", "late", 8)], "2") == sorted([*told, ("f", "late")]) and seen.pop() == []
    assert {r.extractor for r in K.entries(spark, folder).collect()} == {"2"}
    assert run([], "2") == [] and seen.pop() == []


def test_second_generation_of_a_key_is_not_read(spark, tmp_path):
    for n in (1, 2):
        spark.createDataFrame([("k", f"w{n}")], "key string, word string").write.parquet(f"{tmp_path}/step-0000000{n}/rows")
        spark.createDataFrame([("k", "1")], K.KEYS).write.parquet(f"{tmp_path}/step-0000000{n}/keys")
    assert [r.word for r in K.rows(spark, str(tmp_path), "1", "word string").collect()] == ["w1"]
    K.compact(spark, str(tmp_path), "1", "word string")
    assert [r.word for r in K.rows(spark, str(tmp_path), "1", "word string").collect()] == ["w1"]


def test_filter_knows_its_keys_and_few_others(spark):
    keys = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    words = K.filter_words(keys(0, 2000), 1 << 15)
    assert K.may_know(keys(0, 2000), words).where("NOT may").count() == 0
    assert K.may_know(keys(2000, 6000), words).where("may").count() < 200
