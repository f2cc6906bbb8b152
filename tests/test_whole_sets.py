"""Queries over the whole of what they are about."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.operators import vector

FOLDER = "/root/testdata/sf0.001"


def test_every_twentieth_vector_asks_all_others(spark):
    rows = sorted(spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    v = np.array([r.embedding for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    score = v @ v.T
    np.fill_diagonal(score, -2)
    want = {(rows[i].vec_id, rows[j].vec_id) for i, r in enumerate(rows) if r.vec_id % 20 == 0 for j in np.argsort(-score[i], kind="stable")[:3]}
    got = entry.queries()["vector_topk_plain"](spark, FOLDER).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == 75
    assert entry.queries()["retrieval_metrics"](spark, FOLDER).first().n_queries == 25


def test_copies_and_passes_of_the_bulk_path(spark):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(30, 4)).tolist()
    rows = spark.createDataFrame([(i, some[0] if i % 3 else some[i % 30]) for i in range(600)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    plain, bulk = (sorted((r.query_id, r.vector_rank, r.vec_id) for r in vector.top_k(asked, rows, 4, block=10, bulk=b).collect()) for b in (False, True))
    assert plain == bulk and len(plain) == 120


def test_long_updates_are_taken(spark, tmp_path):
    rows = [(10, "a\n" * 7000), (20, "b"), (21, "c\n" * 7000), (30, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.version, r.n_chunks) for r in entry.queries()["document_upsert"](spark, str(tmp_path)).collect()}
    assert got == {(10, "new", 7001), (20, "new", 2), (21, "old", 7000), (30, "new", 1)}


def test_contexts_hold_whole_turns(spark, tmp_path):
    rows = [(1, 2, "b", "y" * 20_000), (1, 1, "a", "x" * 150), (2, 1, "a", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_parts, r.context) for r in entry.queries()["context_build"](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {1: (2, md5("a: " + "x" * 150 + "\n\nb: " + "y" * 20_000)), 2: (1, md5("a: "))}


def test_bulk_path_with_query_keys_of_any_type(spark):
    rows = spark.range(60).selectExpr("id as vec_id", "array(cast(id % 7 as float), cast(1 + id % 5 as float)) as embedding")
    for kind in ("smallint", "string", "date", "decimal(12,2)"):
        key = "date_add(date'2020-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
        asked = spark.range(4).selectExpr(f"{key} as query_id", "array(cast(id as double), 2.0D) as query_vec")
        plain, bulk = (vector.top_k(asked, rows, 3, bulk=b) for b in (False, True))
        assert bulk.schema["query_id"].dataType == plain.schema["query_id"].dataType
        pick = lambda df: sorted((str(r.query_id), r.vector_rank, r.vec_id) for r in df.collect())
        assert pick(plain) == pick(bulk) and len(pick(bulk)) == 12
