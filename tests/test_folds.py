"""Folds over very long documents, and against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking

LONG = 200_000


def loop(paras, cap, most, target, overlap_tokens, overlap_sum):
    """Packing by the rules, one paragraph after the other."""
    packs, cur, tok = [], [], 0
    for i, (size, tags) in enumerate(paras):
        if size > cap:
            if cur:
                packs.append(cur)
            packs.append([i])
            cur, tok = [], 0
            continue
        if cur and (tok + size > cap or len(cur) >= most or tok >= target):
            packs.append(cur)
            last_size, last_tags = paras[cur[-1]]
            if last_size <= overlap_tokens and set(last_tags) & set(tags) and last_size + size <= overlap_sum:
                cur, tok = [cur[-1], i], last_size + size
            else:
                cur, tok = [i], size
        else:
            cur, tok = [*cur, i], tok + size
    return packs + ([cur] if cur else [])


@pytest.mark.parametrize("seed", range(4))
def test_greedy_packs(spark, seed):
    rng = random.Random(seed)
    docs = [(k, [(rng.randrange(0, 130), rng.sample("abcd", rng.randrange(0, 3))) for _ in range(rng.randrange(0, 60))]) for k in range(25)] + [(99, None)]
    df = spark.createDataFrame(docs, "k int, paras array<struct<t:int,tags:array<string>>>")
    sizes = {"cap": 100, "most": 5, "target": 60, "overlap_tokens": 30, "overlap_sum": 80}
    got = {r.k: r.p for r in df.select("k", chunking.greedy_packs(links=("tags",), **sizes).alias("p")).collect()}
    assert got == {k: loop(p or [], **sizes) for k, p in docs}


@pytest.fixture(scope="module")
def long(spark):
    line = lambda i: F.struct(F.lit(1).alias("page"), F.concat(i.cast("string"), F.lit(". text of it")).alias("text"), (i % 7).cast("int").alias("t"), F.array((i % 3).cast("string")).alias("tags"))
    return spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(LONG)), line).alias("paras"))


@pytest.mark.parametrize("fold", [lambda: chunking.greedy_packs(links=("tags",), cap=100, target=50), lambda: chunking.simple_packs(cap=60), lambda: chunking.sequential_paragraphs("paras")])
def test_a_document_of_200_000_lines(long, fold):
    long.limit(1).select(F.size("paras")).collect()
    began = time.time()
    n = long.select(F.size(fold())).first()[0]
    assert n > 1000 and time.time() - began < 10


def test_sentences_of_a_long_text(spark):
    began = time.time()
    df = spark.range(1).select(F.repeat(F.lit("Some words of it. "), LONG).alias("text"))
    assert df.select(F.size(chunking.sentence_packs(F.col("text")))).first()[0] > 1000 and time.time() - began < 15


def test_numbered_paragraphs(spark):
    rows = [[(1, "head"), (1, "1. One"), (1, " goes on "), (2, "3. not next"), (2, "2.Two"), (3, "   "), (3, "3\tThree"), (4, "12345 no number")], [(1, "3 begins at three"), (1, "4. four")], [], None]
    df = spark.createDataFrame(enumerate(rows), "k int, lines array<struct<page:int,text:string>>")
    got = {r.k: [tuple(p) for p in r.p] for r in df.select("k", chunking.sequential_paragraphs().alias("p")).collect()}
    assert got == {0: [(1, 1, 1, "head"), (1, 1, 2, "One goes on 3. not next"), (2, 2, 2, "Two"), (3, 3, 4, "Three 12345 no number")], 1: [(3, 1, 1, "begins at three"), (4, 1, 1, "four")], 2: [], 3: []}
