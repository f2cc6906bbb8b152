"""Hybrid retrieval: over-fetch, reciprocal rank, metadata boosts, graph fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_nonblank
from .vector import distance

# Constants of the scores.
RRF_K = 60
PRIMARY, EXTRACTED, CORRESPONDS, RELATED = 2.0, 1.5, 1.0, 0.5
GRAPH_BOOST, ID_BOOST, CASE_BOOST = 0.50, 0.20, 0.10
MATCHED_SECTION = 0.5
CASE_WORDS = "case|judgment|court|precedent|ruling|cited"


def fetch_size(k: int) -> int:
    """Candidates to fetch for ``k`` results."""
    return max(10, 3 * k)


def reciprocal_rank_score(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (rank + k)


def boost(primary: Column, extracted: Column, corresponds: Column, related: Column) -> Column:
    """Two ladders: named by the query, and known to the graph; the higher step of each counts."""
    named = F.when(primary, PRIMARY).when(extracted, EXTRACTED).otherwise(0.0)
    known = F.when(corresponds, CORRESPONDS).when(related, RELATED).otherwise(0.0)
    return named + known


def boost_reasons(primary: Column, extracted: Column, corresponds: Column, related: Column) -> Column:
    named = F.when(primary, "primary_target").when(extracted, "explicit_section")
    known = F.when(corresponds, "corresponds_to").when(related, "graph_related")
    return F.array_compact(F.array(named, known))


def rerank(candidates: DataFrame, primary: Column, extracted: Column, corresponds: Column, related: Column, *, query: str = "query_id", key: str = "vec_id", rrf_k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Candidates with their scores, in order of reciprocal rank plus boosts; the vector rank breaks ties."""
    flags = [F.coalesce(x, F.lit(False)) for x in (primary, extracted, corresponds, related)]
    out = candidates.withColumn("boost_applied", boost(*flags)).withColumn("boost_reasons", boost_reasons(*flags))
    out = out.withColumn("rrf_score", F.round(reciprocal_rank_score(F.col("vector_rank"), rrf_k) + F.col("boost_applied"), 6))
    out = out.withColumn("vector_distance", distance(F.col("score")))
    order = Window.partitionBy(query).orderBy(F.desc("rrf_score"), "vector_rank", key)
    out = out.withColumn("final_rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("final_rank") <= limit)


def neutral(candidates: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """The same columns without boosts: vector order is final."""
    out = candidates.withColumn("boost_applied", F.lit(0.0)).withColumn("boost_reasons", F.expr("cast(array() as array<string>)"))
    out = out.withColumn("rrf_score", F.round(reciprocal_rank_score(F.col("vector_rank"), rrf_k), 6))
    return out.withColumn("vector_distance", distance(F.col("score"))).withColumn("final_rank", F.col("vector_rank"))


def statute_candidates(hits: DataFrame, section: Column, *keep: str) -> DataFrame:
    """Hits of a search as candidates for provisions: ``query_id, chunk_id, section_id, vector_rank, vector_distance``."""
    return hits.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), section.alias("section_id"), "vector_rank", distance(F.col("score")).alias("vector_distance"), *keep)


def judgment_candidates(hits: DataFrame, case: Column, *keep: str) -> DataFrame:
    """Hits as candidates for cases, with ``case_id``; one without a case is of an unknown one."""
    return hits.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), first_nonblank(case, F.lit("Unknown case")).alias("case_id"), "vector_rank", distance(F.col("score")).alias("vector_distance"), *keep)


def has_section_id(query: Column) -> Column:
    return query.rlike("[A-Z]{2,5}:\\d+[A-Z]?")


def has_case_word(query: Column) -> Column:
    return F.lower(query).rlike(CASE_WORDS)


def fuse(hits: DataFrame, in_graph: Column, query_text: Column, *, graph_found: Column | None = None, base: Column | None = None, query: str = "query_id", rank: str = "vector_rank") -> DataFrame:
    """Final scores with the graph's support; without any graph hit the order stays.

    Only the graph boost depends on the candidate; the two others are the same
    for all of a query's candidates and shift the score alone.
    """
    base = F.coalesce(F.col("rrf_score"), F.lit(0.0)) if base is None else base
    support = F.coalesce(in_graph, F.lit(False))
    boosts = F.map_filter(F.create_map(F.lit("graph"), F.when(support, GRAPH_BOOST).otherwise(0.0), F.lit("statute_id"), F.when(has_section_id(query_text), ID_BOOST).otherwise(0.0), F.lit("case"), F.when(has_case_word(query_text), CASE_BOOST).otherwise(0.0)), lambda k, v: v > 0)
    out = hits.withColumn("fusion_boosts", boosts)
    total = F.aggregate(F.map_values("fusion_boosts"), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("final_score", F.round(base + total, 6))
    found = F.max(support).over(Window.partitionBy(query)) if graph_found is None else graph_found
    out = out.withColumn("source", F.when(found, "hybrid").otherwise("vector"))
    return out.withColumn("fused_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("final_score"), rank)))


def matched_sections_boost(extracted: Column, references: Column, contains: bool = False) -> Column:
    """Half a point for every section of the query that a judgment refers to.

    ``contains`` looks ids up as parts of the joined references, so that a short
    id also matches the longer ones it begins.
    """
    if contains:
        joined = F.array_join(references, ",")
        return F.size(F.filter(extracted, lambda s: F.contains(joined, s))) * F.lit(MATCHED_SECTION)
    return F.size(F.array_intersect(extracted, references)) * F.lit(MATCHED_SECTION)


def additions(hybrid: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """What the hybrid search found and the plain one did not."""
    return hybrid.join(plain.select(*keys).distinct(), keys, "left_anti")
