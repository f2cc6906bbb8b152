"""Build the property graph of a corpus: its documents and conversations, what they refer to and discuss.

    python -m jobs.graph_build --documents /corpus/documents --conversations /corpus/conversations --out /index/graph

Every document and every turn is a chunk; sources and conversations are the cases
that have them. Chunks refer to the sections that they name and discuss the concepts
whose patterns they hold; a chunk whose text an earlier one has (by id) points to
the first of them. Under ``out`` there are ``found`` (chunks with what was found in their
texts, which are read once for it), ``nodes`` (partitioned by label), ``edges``
(partitioned by type) and ``report`` (JSON, partitioned by kind): counts, ids that
a label has twice, edges without an end, nodes without a name, and in how many cases
each concept is discussed. The report is made of the tables as they were written.

A run replaces all four, so running it again gives the same; one that dies is
mended by the next.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.references import short_references
from corpusmill.functions.text import excerpt, numbered_id, slug, tagged
from corpusmill.operators import graph

CONFIG = Path(__file__).with_suffix(".json")

log = logging.getLogger("jobs.graph_build")


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def chunks(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """``chunk_id, case_id, text`` of all documents and turns that have an id."""
    said = F.concat(F.lit("CONV_"), F.col("conv_id").cast("string"))
    docs = documents.select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("SOURCE_"), slug(F.col("source"))).alias("case_id"), "text")
    turns = conversations.select(numbered_id(said, "TURN", F.col("turn")).alias("chunk_id"), said.alias("case_id"), "text")
    return docs.unionByName(turns).where("chunk_id is not null")


def _hash(text: Column) -> Column:
    """Tells texts apart; null for blank ones."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), F.sha2(text, 256))


def same_texts(rows: DataFrame) -> DataFrame:
    """Edges from chunks to the first one of the same text; blank texts are like nothing."""
    return _same(rows.select("chunk_id", _hash(F.col("text")).alias("h")))


def _same(rows: DataFrame) -> DataFrame:
    """Only hashes of texts are grouped, and only those that repeat are joined."""
    each = rows.where("h is not null").select("chunk_id", "h")
    first = each.groupBy("h").agg(F.min("chunk_id").alias("dst"), F.max("chunk_id").alias("_last")).where("dst < _last").select("h", "dst")
    return each.join(first, "h").where("chunk_id > dst").select(F.col("chunk_id").alias("src"), "dst", F.lit("SAME_TEXT").alias("type"))


def found_in(rows: DataFrame, concepts: dict[str, str], name_chars: int) -> DataFrame:
    """Chunks with the beginning of their text, its hash ``h`` and what is found in it."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("chunk_id", "case_id", excerpt(F.col("text"), name_chars).alias("text"), _hash(F.col("text")).alias("h"), short_references(text).alias("legal_references"), tagged(text, concepts).alias("legal_concepts"))


def build(found: DataFrame) -> graph.Graph:
    """Nodes and edges, each once; chunks are named by the beginning of their text."""
    own = graph.judgment_graph(found.drop("h").withColumn("cited_cases", F.expr("cast(array() as array<string>)")))
    return graph.Graph(own.nodes, graph.merge_edges(own.edges, _same(found)))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, key, n`` of what the tables hold and what is wrong with them."""
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("key").cast("string"), F.col("n").cast("long"))
    counts = lambda df, by, name: kind(df.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n")), name)
    ids = nodes.select("id").distinct()
    ends = edges.select("type", F.explode(F.array("src", "dst")).alias("id"))
    of_cases = edges.where("type = 'HAS_CHUNK'").select(F.col("src").alias("case"), F.col("dst").alias("src"))
    told = edges.where("type = 'DISCUSSES'").select("src", F.col("dst").alias("key")).join(of_cases, "src").groupBy("key").agg(F.count_distinct("case").alias("n"))
    parts = [
        counts(nodes, "label", "nodes"),
        counts(edges, "type", "edges"),
        counts(graph.violations(nodes), "label", "repeated"),
        counts(ends.join(ids, "id", "left_anti"), "type", "dangling"),
        counts(nodes.where("coalesce(name, '') = ''"), "label", "unnamed"),
        kind(told, "concept_cases"),
    ]
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, documents: str, conversations: str, out: str, *, concepts: dict[str, str] | None = None, name_chars: int = 80) -> dict[str, int]:
    """Write the graph of two tables under ``out``; rows read and written."""
    out = out.rstrip("/")
    docs, turns = spark.read.parquet(documents), spark.read.parquet(conversations)
    said = {"documents": docs.count(), "turns": turns.count()}
    log.info("read %d documents from %s, %d turns from %s", said["documents"], documents, said["turns"], conversations)
    found = found_in(chunks(docs, turns), concepts or {}, name_chars)
    found.write.mode("overwrite").parquet(f"{out}/found")
    made = build(spark.read.schema(found.schema).parquet(f"{out}/found"))
    made.edges.write.mode("overwrite").partitionBy("type").parquet(f"{out}/edges")
    made.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{out}/nodes")
    nodes, edges = graph_tables(spark, out)
    report(nodes, edges).coalesce(1).write.mode("overwrite").partitionBy("kind").json(f"{out}/report")  # some dozen rows
    told = reports(spark, out).collect()
    said |= {kind: sum(r.n for r in told if r.kind == kind) for kind in ("nodes", "edges", "repeated", "dangling", "unnamed")}
    log.info("wrote %d nodes and %d edges to %s: %d repeated, %d dangling, %d unnamed", *(said[k] for k in ("nodes", "edges")), out, *(said[k] for k in ("repeated", "dangling", "unnamed")))
    return said


def graph_tables(spark: SparkSession, out: str) -> graph.Graph:
    """Nodes and edges as they were written."""
    read = lambda name, columns: spark.read.schema(columns).parquet(f"{out.rstrip('/')}/{name}")
    return graph.Graph(read("nodes", "id string, name string, label string"), read("edges", "src string, dst string, type string"))


def reports(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("key string, n long, kind string").json(f"{out.rstrip('/')}/report")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "conversations", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from corpusmill.session import session

    spark = session("graph_build")
    try:
        run(spark, args.documents, args.conversations, args.out, **config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
