"""Merges into tables at a path: what they touch, what a failed one leaves, and replays."""

import glob

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import sinks, tables


def files(path):
    return {f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(spark, path):
    return sorted(map(tuple, tables.read_table(spark, path).collect()))


@pytest.fixture()
def path(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", 0) for i in range(200)], "id long, text string, at int")
    assert tables.upsert_table(str(tmp_path / "t"), df, "id", buckets=16) == (200, 16, 16)
    return str(tmp_path / "t")


def test_two_upserts_touch_only_their_buckets(spark, path):
    before = files(path)
    new = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (1000, "added", 1), (None, "no key", 1), (5, " ", 3)], "id long, text string, at int")
    merged = tables.upsert_table(path, new, "id", order="at", text="text")
    assert merged.rows == 2 and merged.rewritten <= 2 and merged.buckets == 16
    got = rows(spark, path)
    assert len(got) == 201 and (3, "new", 2) in got and (1000, "added", 1) in got and (5, "t5", 0) in got
    kept = before & files(path)
    assert len({f.split("bucket_of_16=")[1].split("/")[0] for f in kept}) >= 14
    again = tables.upsert_table(path, new, "id", order="at", text="text")
    assert again == merged and rows(spark, path) == got and before & files(path) == kept


def test_a_killed_merge_leaves_the_table(spark, path):
    before, held = rows(spark, path), files(path)
    bad = spark.range(50).select("id", F.when(F.col("id") < 40, F.lit("x")).otherwise(F.raise_error(F.lit("killed"))).alias("text"), F.lit(1).alias("at"))
    with pytest.raises(Exception, match="killed"):
        tables.merge_table(path, bad, spark.range(50), "id")
    assert rows(spark, path) == before and files(path) == held
    good = spark.range(50).select("id", F.lit("x").alias("text"), F.lit(1).alias("at"))
    tables.upsert_table(path, good, "id")
    assert sum(r[1] == "x" for r in rows(spark, path)) == 50


def test_insert_keeps_what_is_there(spark, path):
    new = spark.createDataFrame([(3, "new", 1), (300, "a", 1), (300, "b", 2)], "id long, text string, at int")
    tables.insert_into_table(path, new, "id", order="at")
    got = rows(spark, path)
    assert (3, "t3", 0) in got and (300, "b", 2) in got and len(got) == 201
    assert tables.insert_into_table(path, new, "id").rows == 0 and rows(spark, path) == got


def test_delete_empties_buckets_too(spark, path):
    tables.delete_from_table(path, spark.range(7, 5000), "id")
    assert [r[0] for r in rows(spark, path)] == list(range(7))
    assert tables.delete_from_table(path, spark.range(7, 5000), "id").rewritten == 0
    tables.delete_from_table(path, spark.range(5000), "id")
    assert rows(spark, path) == []
    tables.upsert_table(path, spark.createDataFrame([(1, "back", 0)], "id long, text string, at int"), "id")
    assert rows(spark, path) == [(1, "back", 0)]
    with pytest.raises(FileNotFoundError):
        tables.delete_from_table(path + "x", spark.range(3), "id")


def test_documents_lose_their_tails(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "doc string, n int, text string"
    tables.replace_in_table(path, spark.createDataFrame([("a", i, "x") for i in range(5)] + [("b", 0, "y"), (None, 0, "z")], schema), spark.createDataFrame([("a",), ("b",), (None,)], "doc string"), "doc", 4)
    tables.replace_in_table(path, spark.createDataFrame([("a", 0, "new")], schema), spark.createDataFrame([("a",), ("b",)], "doc string"), "doc")
    assert rows(spark, path) == [("a", 0, "new")]


def test_columns_come_and_go(spark, path):
    tables.upsert_table(path, spark.createDataFrame([(1, "one", "more")], "id int, text string, extra string"), "id")
    got = tables.read_table(spark, path)
    assert got.columns == ["id", "text", "at"] and (1, "one", None) in {tuple(r) for r in got.where("id = 1").collect()}


def test_empty_sources(spark, path, tmp_path):
    before, held = rows(spark, path), files(path)
    assert tables.upsert_table(path, tables.read_table(spark, path).limit(0), "id").rewritten == 0
    assert rows(spark, path) == before and files(path) == held
    with pytest.raises(ValueError, match="no table of buckets"):
        spark.range(3).write.parquet(str(tmp_path / "plain"))
        tables.stored(spark, str(tmp_path / "plain"))


def test_blank_keys_replay(spark):
    target = spark.createDataFrame([("a", "x")], "k string, text string")
    new = spark.createDataFrame([("", "one"), (None, "two"), (" ", "one")], "k string, text string")
    once = sinks.upsert(target, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.upsert(once, new, "k").collect()))
    assert once.count() == 3
