"""Validation rules, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lookup


def findings(df: DataFrame, key: list[str], rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """One row per rule that a row breaks: severity and message. Rules are ``(severity, condition, message)``."""
    said = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for s, c, m in rules]
    return df.select(*key, F.explode(F.array_compact(F.array(*said))).alias("f")).select(*key, "f.severity", "f.message")


def first_and_rest(rows: DataFrame, group: str, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group, and how many more there are."""
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)
    return first.join(counts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def duplicates(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """All but the first row of each group of equal rows."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("nth > 1")


def token_stats(df: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    t = F.col(tokens)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.round(F.avg(t), 2).alias("mean_tokens"), F.round(F.median(t), 2).alias("median_tokens"), F.floor(F.avg(F.when(t > 0, t))).cast("int").alias("avg_nonzero"))


def valid_chunk(chunk_id: Column, chunk_type: Column, text: Column) -> Column:
    return (F.coalesce(chunk_id, F.lit("")) != "") & (F.coalesce(chunk_type, F.lit("")) != "") & text.isNotNull()


def frequencies(df: DataFrame, item: str, case: str) -> DataFrame:
    """In how many cases each item occurs, the most frequent first."""
    return df.groupBy(item).agg(F.count_distinct(case).alias("case_count"), F.array_sort(F.collect_set(case)).alias("case_ids")).orderBy(F.desc("case_count"), item)


def by_alias(df: DataFrame, raw: str, aliases: dict[str, str], otherwise: str | None = None) -> DataFrame:
    """``(name, n, variants)``: rows by what a name stands for, and the distinct spellings met, sorted.

    A spelling without an alias stands for ``otherwise``, or for itself. Spellings
    are counted before names are, so no row holds more than its distinct ones.
    """
    name = F.coalesce(lookup(aliases, F.col(raw)), F.lit(otherwise) if otherwise is not None else F.col(raw))
    each = df.groupBy(F.col(raw).alias("_raw"), name.alias("name")).agg(F.count("*").alias("_n"))
    return each.groupBy("name").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_set("_raw")).alias("variants"))
