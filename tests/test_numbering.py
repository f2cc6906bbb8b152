"""Numbering by ranges against a window, and where one group has nearly all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import numbering, quality


def table(spark, n=5000):
    return spark.range(n).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 10 == 1, F.concat(F.lit("g"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("g"), F.when(F.col("id") == 77, F.lit(None)).otherwise(F.hash("id")).alias("at"), "id")


def test_as_a_window(spark, tmp_path):
    df = table(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("at", "id")).cast("long"))
    got = numbering.numbered(df, ["g"], ["at", "id"], str(tmp_path / "n"))
    assert got.columns == ["g", "at", "id", "n"]
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_one_group_uses_all_tasks(spark, tmp_path):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.hash("id").alias("at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.numbered(df, ["g"], ["at", "id"], str(tmp_path / "n"))
        parts = spark.read.parquet(str(tmp_path / "n")).groupBy("_part").count().collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 10_000
    assert "hashpartitioning(_part" in plan
    assert sorted(r.n for r in out.select("n").collect()) == list(range(1, 20_001))


def test_ties_empty_and_clashes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)] * 10 + [("b", 1)], "g string, at int")
    got = numbering.numbered(df, ["g"], ["at"], str(tmp_path / "n")).collect()
    assert sorted(r.n for r in got if r.g == "a") == list(range(1, 11))
    assert numbering.numbered(df.limit(0), ["g"], ["at"], str(tmp_path / "m")).count() == 0
    with pytest.raises(ValueError):
        numbering.numbered(df.withColumn("n", F.lit(1)), ["g"], ["at"], str(tmp_path / "o"))


def test_first_and_rest_counts_without_the_whole_group(spark):
    df = table(spark).where("g is not null")
    out = quality.first_and_rest(df, "g", ["at", "id"], 5)
    w = Window.partitionBy("g")
    want = df.withColumn("nth", F.row_number().over(w.orderBy("at", "id"))).withColumn("more", F.greatest(F.count("*").over(w) - 5, F.lit(0))).where("nth <= 5")
    assert out.select(*want.columns).exceptAll(want).count() == want.exceptAll(out.select(*want.columns)).count() == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
