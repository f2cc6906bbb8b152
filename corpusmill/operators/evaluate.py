"""Retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_relevant(hits: DataFrame, relevant: Column, query: str = "query_id", rank: str = "vector_rank") -> DataFrame:
    """Per query the rank of its first relevant hit, null where there is none."""
    return hits.groupBy(query).agg(F.min(F.when(relevant, F.col(rank))).alias("rank"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rates at 1 and 3 in percent, and the mean reciprocal rank."""
    hit = lambda k: F.round(100 * F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 2)
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), F.count_if(F.col("rank") <= 1).alias("hits_1"), F.count_if(F.col("rank") <= 3).alias("hits_3"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), F.round(F.avg(reciprocal(F.col("rank"))), 4).alias("mrr"))


def baseline(gold: DataFrame, laws: DataFrame, k: int = 5) -> DataFrame:
    """Per gold query its first ``k`` sections in order, the rank of the first expected one, and its reciprocal.

    ``gold(query_id, query_text, expected)``; ``laws(query_id, section_id, rank)``.
    """
    some = laws.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section_id"))), lambda x: x["section_id"]).alias("found"))
    both = gold.join(some, "query_id", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<string>)")))
    at = F.array_min(F.filter(F.transform("expected", lambda s: F.array_position(F.col("found"), s)), lambda i: i > 0))
    return both.withColumn("rank", at).withColumn("reciprocal_rank", F.round(reciprocal(F.col("rank")), 6))


def latencies(runs: DataFrame, base: str, mode: str = "mode", seconds: str = "seconds") -> DataFrame:
    """Mean latency of each mode over its timed queries, and the difference from the base mode."""
    out = runs.groupBy(mode).agg(F.count("*").alias("n"), F.round(F.avg(seconds), 3).alias("avg_seconds"))
    first = out.where(F.col(mode) == base).select(F.col("avg_seconds").alias("_b"))
    return out.join(F.broadcast(first), how="cross").select(mode, "n", "avg_seconds", F.round(F.col("avg_seconds") - F.col("_b"), 3).alias("d_seconds"))  # one row


def against(modes: DataFrame, baseline: str, mode: str = "mode") -> DataFrame:
    """Metrics of all modes with their differences from the baseline mode."""
    base = modes.where(F.col(mode) == baseline).select(*(F.col(c).alias(f"b_{c}") for c in ("hit_1", "hit_3", "mrr")))
    out = modes.crossJoin(F.broadcast(base.limit(1)))
    return out.select(*modes.columns, F.round(F.col("hit_1") - F.col("b_hit_1"), 2).alias("d_hit_1"), F.round(F.col("hit_3") - F.col("b_hit_3"), 2).alias("d_hit_3"), F.round(F.col("mrr") - F.col("b_mrr"), 4).alias("d_mrr"))


def of_modes(relevant: Column, k: int, **hits: tuple[DataFrame, str]) -> DataFrame:
    """Metrics of each search mode over its first ``k`` hits: ``mode=(hits, rank column)``, such as plain, reranked and fused."""
    ranks = [first_relevant(rows.where(F.col(rank) <= k), relevant, rank=rank).withColumn("mode", F.lit(mode)) for mode, (rows, rank) in hits.items()]
    return metrics(reduce(DataFrame.unionByName, ranks), ["mode"])
