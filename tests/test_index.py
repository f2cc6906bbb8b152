"""Search by inverted lists against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index, vector

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@pytest.fixture(scope="module")
def built(vectors, tmp_path_factory):
    return index.build(vectors, str(tmp_path_factory.mktemp("index")))


def pairs(df):
    return sorted((r.query_id, r.vector_rank, r.vec_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("probes", [1, 3, 10_000])
def test_exact_search_is_exact(vectors, queries, built, probes):
    want = pairs(vector.top_k(queries, vectors, 7))
    assert pairs(index.search(queries, built, 7, probes=probes, exact=True)) == want


def test_blocks_change_nothing(vectors, queries, built, monkeypatch):
    want = pairs(vector.top_k(queries, vectors, 5))
    monkeypatch.setattr(index, "ROWS_OF_BLOCK", 3)
    monkeypatch.setattr(index, "QUERIES_OF_BLOCK", 2)
    assert pairs(index.search(queries, built, 5, probes=2, exact=True)) == want


def test_every_row_is_in_one_list(spark, vectors, built):
    rows = spark.read.parquet(f"{built.path}/rows")
    assert rows.count() == vectors.count() == built.sizes.sum() and rows.select("vec_id").distinct().count() == vectors.count()
    assert {"label", "embedding", "list"} <= set(rows.columns)


def test_calibration_finds_the_recall(vectors, queries, built):
    probes, got = index.calibrated(queries, built, 10)
    assert got >= 0.95 and 1 <= probes <= len(built.lists)
    truth = vector.top_k(queries, vectors, 10)
    assert index.recall(index.search(queries, built, 10, probes=probes), truth, "query_id", "vec_id") >= 0.95
    assert index.calibrated(queries.limit(0), built, 10) == (1, 1.0)


def test_files_of_other_lists_are_not_read(spark, queries, built):
    some = queries.limit(1)
    plan = index.search(some, built, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[list#\d+ IN \(([\d,]+)\)", plan)
    assert asked and len(asked[1].split(",")) == 2 < len(built.lists)


def test_odd_vectors_and_copies(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [float("nan"), 1.0, 0.0, 0.0]), (1003, [1.0, None, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    built = index.build(corpus, str(tmp_path / "i"), lists=5)
    assert built.sizes.sum() == 560
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [-1.0, 0.0, 0.0, 0.5]), (3, None), (4, [0.0] * 4)], "query_id long, query_vec array<float>")
    got = pairs(index.search(asked, built, 6, probes=1, exact=True))
    assert [r[2] for r in got if r[0] == 1] == list(range(100, 106))
    assert got == pairs(vector.top_k(asked.where("query_id < 3"), corpus.where("vec_id < 1000"), 6))


def test_an_empty_corpus(spark, queries, vectors, tmp_path):
    built = index.build(vectors.limit(0), str(tmp_path / "i"))
    assert len(built.lists) == 0 and index.search(queries, built, 3, exact=True).count() == 0
    full = index.build(vectors, str(tmp_path / "j"), lists=4)
    assert index.search(queries.limit(0), full, 3, exact=True).count() == 0


def test_reopened(spark, queries, built):
    again = index.opened(spark, built.path)
    assert pairs(index.search(queries, again, 3, probes=2)) == pairs(index.search(queries, built, 3, probes=2))


def test_hybrid_search_by_index(spark, tmp_path):
    from corpusmill.operators import search
    from corpusmill.plans.vector_queries import legal

    t = legal(spark, FOLDER)
    lists = index.build(t["statutes"], str(tmp_path / "i"), key="chunk_id")
    shown = lambda laws: sorted((r.query_id, r.rank, r.chunk_id, r.section_id, r.rrf_score) for r in laws.collect())
    want = shown(search.research(t["queries"], t["statutes"], None, t["edges"], t["nodes"], bulk=True)[0])
    assert len(want) == 75
    assert shown(search.research(t["queries"], t["statutes"], None, t["edges"], t["nodes"], lists=lists, probes=2, exact=True)[0]) == want


def test_exact_search_tells_few_pairs(spark, tmp_path, monkeypatch):
    """Pairs that go on from the scan don't grow with the lists: those below a query's floor stay behind."""
    rng = np.random.default_rng(2)
    corpus = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(2000)], "vec_id long, embedding array<float>")
    built = index.build(corpus, str(tmp_path / "i"))
    asked = corpus.where("vec_id < 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    seen, ranked = [], index._ranked
    monkeypatch.setattr(index, "_ranked", lambda pairs, *rest: seen.append(pairs.count()) or ranked(pairs, *rest))
    got = pairs(index.search(asked, built, 5, probes=len(built.lists), exact=True))
    assert len(built.lists) > 40 and sum(seen) < 100 * 5 * 8
    assert got == pairs(vector.top_k(asked, corpus, 5))
    monkeypatch.undo()
    calls, scanned = [], index._scanned
    monkeypatch.setattr(index, "_scanned", lambda *a, **k: calls.append(1) or scanned(*a, **k))
    index.calibrated(asked, built, 5)
    assert len(calls) == 2  # one exact search, however often probes are doubled
