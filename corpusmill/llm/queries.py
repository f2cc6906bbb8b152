"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, byte_bpe, decontaminate, heap_bpe, hnsw_dedup, html_extract, license_scan, line_dedup, maxent_lm, ngram_join, quality_model, reshard
from .shared import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"), min_words=50)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extraction_report(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_report(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard_report(table(spark, sf_dir, "documents"), shards=8)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return align.alignment_report(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))


def op12_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return heap_bpe.heap_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.REPORT_SQL, "op10_decontamination": decontaminate.REPORT_SQL, "op2_license_scan": license_scan.REPORT_SQL, "op4_line_dedup": line_dedup.REPORT_SQL, "op9_embedding_near_dedup": hnsw_dedup.REPORT_SQL}
