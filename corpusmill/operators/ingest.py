"""Ingestion of single statutes and judgments as tables: conflicts, replacement, points and graph together."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.references import judgment_references
from ..functions.text import numbered_id, slug, statute_chunk_id, word_count
from . import chunking, graph


class Ingested(NamedTuple):
    """The collection and graph after an ingest, and what became of each request."""

    collection: DataFrame
    nodes: DataFrame
    edges: DataFrame
    report: DataFrame


def _admitted(requests: DataFrame, key: str, known: DataFrame, text: str) -> DataFrame:
    """Requests with their status: blank, repeated (a later one of the same key counts), conflict, replaced or new."""
    last = requests.groupBy(key).agg(F.max("request_id").alias("_last"))
    held = known.select(F.col(key).alias("_k")).distinct()
    out = requests.join(last, key).join(held, F.col(key) == F.col("_k"), "left")
    status = (
        F.when(~F.coalesce(F.col(text), F.lit("")).rlike(r"\S"), "blank")
        .when(F.col("request_id") < F.col("_last"), "repeated")
        .when(F.col("_k").isNotNull() & ~F.coalesce("overwrite", F.lit(False)), "conflict")
        .when(F.col("_k").isNotNull(), "replaced")
        .otherwise("new")
    )
    return out.withColumn("status", status).drop("_last", "_k")


def _replaced(collection: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    kept = collection.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.select(*collection.columns).unionByName(fresh.select(*collection.columns))


def statutes(requests: DataFrame, collection: DataFrame, nodes: DataFrame, edges: DataFrame) -> Ingested:
    """Sections put into a collection, with their acts, chunks and correspondences in the graph.

    ``requests(request_id, act, section, title, text, predecessor, successor,
    legal_concepts, overwrite)``; ``collection`` has ``chunk_id, act_id,
    section_id, title, text, legal_concepts, token_count``. A section that is
    there is refused unless it may be overwritten; of several requests for one
    section the last counts; blank texts are refused.
    """
    act, section = F.upper(F.trim("act")), F.trim("section")
    r = requests.withColumns({"act_id": act, "section_number": section, "section_id": F.concat(act, F.lit(":"), section), "text": F.trim("text"), "title": F.trim("title")})
    r = _admitted(r, "section_id", collection, "text").withColumns({"chunk_id": statute_chunk_id(F.col("act_id"), F.col("section_number")), "token_count": word_count(F.col("text"))})
    taken = r.where(F.col("status").isin("new", "replaced"))
    concepts = F.array_join(F.coalesce("legal_concepts", F.expr("cast(array() as array<string>)")), ",")
    whole = _replaced(collection, taken.withColumn("legal_concepts", concepts), "section_id")
    own = graph.statute_graph(taken.withColumns({"predecessor_references": F.array_compact(F.array(F.nullif("predecessor", F.lit("")))), "successor_references": F.array_compact(F.array(F.nullif("successor", F.lit("")))), "legal_references": F.expr("cast(array() as array<string>)"), "legal_concepts": F.expr("cast(array() as array<string>)")}))
    return Ingested(whole, graph.merge_nodes(nodes, own.nodes), graph.merge_edges(edges, own.edges), r.select("request_id", "section_id", "chunk_id", "status"))


def judgments(requests: DataFrame, collection: DataFrame, nodes: DataFrame, edges: DataFrame, cap: int = 1000) -> Ingested:
    """Cases cut into chunks by whole paragraphs and put into a collection, all old chunks of a case leaving first.

    ``requests(request_id, case_id, text, overwrite)``; ``collection`` has
    ``chunk_id, case_id, text, legal_references, token_count``.
    """
    r = _admitted(requests.withColumn("case_id", F.trim("case_id")), "case_id", collection, "text")
    taken = r.where(F.col("status").isin("new", "replaced"))
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    paras = taken.withColumn("_p", parts).select("case_id", F.transform("_p", lambda p: F.struct(p.alias("text"), word_count(p).alias("t"))).alias("paras"))
    packs = paras.select("case_id", F.posexplode(F.transform(chunking.simple_packs(cap=cap), lambda at: F.array_join(F.transform(at, lambda i: F.get(F.col("paras"), i)["text"]), "\n\n"))).alias("n", "text"))
    refs = judgment_references(F.col("text"))
    made = packs.select(numbered_id(slug(F.col("case_id")), "JUDGMENT", F.col("n") + 1).alias("chunk_id"), "case_id", "text", refs.alias("refs"), word_count(F.col("text")).alias("token_count"))
    whole = _replaced(collection, made.withColumn("legal_references", F.array_join("refs", ",")), "case_id")
    none = F.expr("cast(array() as array<string>)")
    own = graph.judgment_graph(made.withColumns({"legal_references": F.col("refs"), "legal_concepts": none, "cited_cases": none}))
    created = made.groupBy("case_id").agg(F.count("*").alias("chunks_created"))
    report = r.select("request_id", "case_id", "status").join(created, "case_id", "left").withColumn("chunks_created", F.when(F.col("status").isin("new", "replaced"), F.coalesce("chunks_created", F.lit(0))).otherwise(F.lit(0)))
    return Ingested(whole, graph.merge_nodes(nodes, own.nodes), graph.merge_edges(edges, own.edges), report.select("request_id", "case_id", "status", "chunks_created"))
