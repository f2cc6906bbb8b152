"""Numbers within groups, some of which may hold most of the rows.

A window over a group puts the group in one task. Here rows are dealt by ranges of
group and order, so a large group has many ranges; each range is numbered by itself,
and a table of the ranges' counts, which is as small as ranges and groups are few,
tells what comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], order: list[str | Column], path: str, into: str = "n") -> DataFrame:
    """``df`` with the place of each row in its group, from 1, by ``order``, which should be complete.

    Without groups all rows are one, and the place is that of a complete sort.

    The dealt rows are written to ``path``, in a folder that executors share, as
    the ranges must stay what they were when they were counted. Null groups are
    groups, and null orders come first, as in a window. Rows that tie in group
    and order are numbered in an order of their own, but each once.
    """
    spark = df.sparkSession
    part, names = "_part", df.columns
    if {part, into} & set(names):
        raise ValueError(f"there is a column {part} or {into}")
    dealt = df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy(part, *group).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(part, *group).orderBy(*order)))
    same = F.col(part) == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(offsets, same).select(*names, (F.col("_local") + F.col("_before")).cast("long").alias(into))
