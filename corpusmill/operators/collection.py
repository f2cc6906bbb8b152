"""Collections of points: tables with a key, a text, a vector and a flat payload."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import rejected
from . import numbering


def matching(where: Mapping[str, Any]) -> Column:
    """All conditions of a filter: a value, ``{"$eq": value}`` or ``{"$in": [values]}``; null values say nothing."""
    out = F.lit(True)
    for name, said in where.items():
        if isinstance(said, Mapping):
            said = said.get("$in", said.get("$eq"))
        if said is None:
            continue
        column = F.col(name)
        out = out & (column.isin(*said) if isinstance(said, (list, tuple, set)) else column == said)
    return out


def scroll(points: DataFrame, where: Mapping[str, Any], limit: int = 1, order: str | None = None) -> DataFrame:
    """The first ``limit`` points of a filter, by ``order`` if one is given; none where a column is missing."""
    if not set(where) <= set(points.columns):
        return points.limit(0)
    out = points.where(matching(where))
    return (out.orderBy(order) if order else out).limit(limit)


def exists_by(points: DataFrame, key: str, where: Mapping[str, Any]) -> DataFrame:
    """``(key, n, found)`` for the keys that have points of a filter."""
    return points.where(matching(where)).groupBy(key).agg(F.count("*").alias("n")).withColumn("found", F.col("n") > 0)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is a collection at ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def create_if_absent(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty collection at ``path``, unless there is one; whether it was made."""
    if has_files(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def rebuild(points: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """The collection at ``path`` written anew, and read back whole, vectors and all."""
    writer = points.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return read(points.sparkSession, path).select(*points.columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def payload(df: DataFrame, key: str, *, texts: tuple[str, ...] = (), numbers: tuple[str, ...] = (), flags: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Flat values of a point: texts default to the empty one, numbers to 0, flags to false, lists become ``a,b``."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c).cast("array<string>"), F.expr("cast(array() as array<string>)")), ",")
    return df.select(
        key,
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts),
        *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in numbers),
        *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in flags),
        *(joined(c).alias(c) for c in lists),
    )


def points(df: DataFrame, key: str, vector: str, collection: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points with their id as text, their vector's length and the collection that they belong to."""
    return df.select(F.col(key).cast("string").alias("point_id"), F.size(vector).alias("dim"), *keep, collection.alias("collection"), vector)


def present(**values: Column) -> Column:
    """Names of the values that hold something (neither null, nor empty, nor false), in the given order."""
    has = lambda v: F.coalesce((v.cast("string") != "") & (v.cast("string") != "false"), F.lit(False))
    return F.array_compact(F.array(*(F.when(has(v), F.lit(name)) for name, v in values.items())))


def without_items(rows: DataFrame, items: DataFrame, key: str, which: Column) -> DataFrame:
    """``(key, passes)``: whether none of a row's items is of that kind."""
    bad = items.where(F.coalesce(which, F.lit(False))).select(key).distinct().withColumn("_bad", F.lit(True))
    return rows.select(key).join(bad, key, "left").select(key, F.col("_bad").isNull().alias("passes"))


def first_rows(df: DataFrame, limit: int, *order: Column, into: str = "nth") -> DataFrame:
    """The first ``limit`` rows of a complete order, with their place."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(into, F.row_number().over(Window.orderBy(*order)))  # of ``limit`` rows


def by_count_and_number(df: DataFrame, limit: int, count: str, label: str, key: str) -> DataFrame:
    """The first rows by falling count, then by the number that the label begins with, then by key."""
    number = F.regexp_extract(label, r"^(\d+)", 1).try_cast("long")
    return first_rows(df, limit, F.desc(count), number.asc_nulls_last(), F.col(key))


def ranked(df: DataFrame, count: str, label: str, key: str, path: str, into: str = "nth") -> DataFrame:
    """All rows with their place in the order of :func:`by_count_and_number`, found without gathering them in one task."""
    number = F.regexp_extract(label, r"^(\d+)", 1).try_cast("long")
    return numbering.numbered(df, [], [F.desc(count), number.asc_nulls_last(), F.col(key).asc()], path, into)


def acceptable(requests: DataFrame, text: str, least: int = 1, most: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """Requests whose trimmed text has ``least`` to ``most`` characters, and the others with their ``reason``."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return rejected(requests, (n == 0, "blank"), (n < least, "too short"), (n > most, "too long"))


def newest_first(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group the places of its rows, the newest first, and the newest value."""
    out = df.groupBy(group).agg(F.sort_array(F.collect_list(order), asc=False).alias("places"), F.max_by(value, order).alias("newest"))
    return out


def counts_by_kind(df: DataFrame, by: list[str], kind: str, kinds: Mapping[str, str]) -> DataFrame:
    """Rows per group, and of each kind that is asked for, under the given names."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == value).alias(name) for name, value in kinds.items()))


def totals(df: DataFrame, by: str, sums: Mapping[str, Column], every: str = "all") -> DataFrame:
    """Row counts and sums per group, and under ``every`` of all rows."""
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias(by), *(c.alias(name) for name, c in sums.items()))
    out = rows.rollup(by).agg(F.count("*").alias("n"), *(F.sum(name).alias(name) for name in sums))
    return out.withColumn(by, F.coalesce(by, F.lit(every)))


def not_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has more than white space."""
    return df.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\S"))


def united(*streams: DataFrame) -> DataFrame:
    """Streams of chunks as one; columns that one lacks are null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
