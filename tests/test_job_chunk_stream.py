"""The chunk job over a folder that grows: two runs, updates, blanks, replays and a batch that dies."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from corpusmill.sources import tables
from jobs import chunk_stream as job

SETTINGS = {"cap_words": 5, "buckets": 4, "files_per_trigger": 1, "concepts": {"Digits": r"\d{3,}"}}
SCHEMA = "doc_id long, text string, lang string, source string"


def put(spark, folder, *rows):
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def held(spark, out):
    return sorted((r.doc_id, r.chunk_id, r.text) for r in job.collection(spark, out).collect())


@pytest.fixture()
def at(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")


def test_two_runs_over_growing_input(spark, at):
    folder, out, cp = at
    put(spark, folder, (1, "one two three\nfour five\n\nsix"), (2, "call 12345"), (None, "nobody's"), (3, " \n "))
    assert job.run(spark, folder, out, cp, **SETTINGS) == 1
    first = [(1, "DOC_1_CHUNK_001", "one two three\nfour five"), (1, "DOC_1_CHUNK_002", "six"), (2, "DOC_2_CHUNK_001", "call 12345")]
    assert held(spark, out) == first
    assert [r.concepts for r in job.collection(spark, out).where("doc_id = 2").collect()] == ["LEGAL_CONCEPT:digits"]
    assert job.run(spark, folder, out, cp, **SETTINGS) == 0 and held(spark, out) == first  # nothing is new
    put(spark, folder, (1, "new"), (4, "a b c d e f g\nh"))
    put(spark, folder, (2, None))
    assert job.run(spark, folder, out, cp, **SETTINGS) == 2
    assert held(spark, out) == [(1, "DOC_1_CHUNK_001", "new"), (4, "DOC_4_CHUNK_001", "a b c d e f g"), (4, "DOC_4_CHUNK_002", "h")]
    report = {r.batch: (r.rows_read, r.documents, r.blank, r.chunks) for r in spark.read.json(f"{out}/report").collect()}
    assert report == {0: (4, 3, 1, 3), 1: (2, 2, 0, 3), 2: (1, 1, 1, 0)}
    assert {r.batch: r["count"] for r in spark.read.parquet(f"{out}/increments").groupBy("batch").count().collect()} == {0: 3, 1: 3}


def test_untouched_buckets_keep_their_files(spark, at):
    folder, out, cp = at
    put(spark, folder, *((i, f"text {i}") for i in range(40)))
    job.run(spark, folder, out, cp, **SETTINGS)
    before = {str(p) for p in Path(out, "collection").rglob("*.parquet")}
    put(spark, folder, (7, "changed"))
    job.run(spark, folder, out, cp, **SETTINGS)
    after = {str(p) for p in Path(out, "collection").rglob("*.parquet")}
    assert len({p.split("bucket_of_4=")[1][0] for p in before & after}) == 3 and (7, "DOC_7_CHUNK_001", "changed") in held(spark, out)


def test_a_batch_that_dies_is_taken_again(spark, at, monkeypatch):
    folder, out, cp = at
    put(spark, folder, (1, "one"), (2, "two"))
    job.run(spark, folder, out, cp, **SETTINGS)
    put(spark, folder, (1, "uno"), (3, "tres"))
    real = tables.replace_in_table

    def dies(*args):
        real(*args)
        raise RuntimeError("lost after the merge")

    monkeypatch.setattr(tables, "replace_in_table", dies)
    with pytest.raises(Exception, match="lost after the merge"):
        job.run(spark, folder, out, cp, **SETTINGS)
    monkeypatch.setattr(tables, "replace_in_table", real)
    assert job.run(spark, folder, out, cp, **SETTINGS) == 1
    assert [t for *_, t in held(spark, out)] == ["uno", "two", "tres"]
    assert spark.read.parquet(f"{out}/increments").where("batch = 1").count() == 2


def test_the_newest_file_counts(spark, at):
    folder, out, cp = at
    put(spark, folder, (1, "zzz old"))
    put(spark, folder, (1, "aaa new"), (1, "aaa new"))
    files = sorted(Path(folder).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    import os

    os.utime(files[0], (1_000_000_000, 1_000_000_000))
    job.run(spark, folder, out, cp, **(SETTINGS | {"files_per_trigger": 10}))
    assert held(spark, out) == [(1, "DOC_1_CHUNK_001", "aaa new")]


def test_an_empty_folder(spark, at):
    folder, out, cp = at
    Path(folder).mkdir()
    assert job.run(spark, folder, out, cp, **SETTINGS) == 0
    assert tables.stored(spark, f"{out}/collection") is None


def test_packs_are_those_of_the_fold(spark):
    from pyspark.sql import functions as F

    from corpusmill.functions.text import word_count
    from corpusmill.operators import chunking

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.split("text", "\n").alias("lines"))
    paras = docs.withColumn("paras", F.transform("lines", lambda x: F.struct(x.alias("text"), word_count(x).alias("t"))))
    fold = F.transform(chunking.simple_packs(cap=60), lambda at: F.array_join(F.transform(at, lambda i: F.get(F.col("paras"), i)["text"]), "\n"))
    both = paras.select(fold.alias("a"), chunking.packs_of_lines(F.transform("lines", word_count), F.col("lines"), 60).alias("b"))
    assert both.where("a is distinct from b").count() == 0 and both.count() >= 200


def test_long_documents_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from corpusmill.operators import chunking

    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("line "), i.cast("string"))).alias("lines"))
    began = time.time()
    packs = df.select(F.size(chunking.packs_of_lines(F.transform("lines", lambda x: F.lit(2)), F.col("lines"), 60))).first()[0]
    assert packs == -(-200_000 // 30) and time.time() - began < 10


def test_command_line(spark, at, tmp_path):
    folder, out, cp = at
    put(spark, folder, (1, "one two"))
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps(SETTINGS))
    done = subprocess.run([sys.executable, "-m", "jobs.chunk_stream", "--source", folder, "--out", out, "--checkpoint", cp, "--config", str(settings)], cwd=Path(job.__file__).parents[1], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read 1 rows of 1 documents (0 blank)" in done.stderr and "wrote 1 chunks" in done.stderr
    assert held(spark, out) == [(1, "DOC_1_CHUNK_001", "one two")]
