import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusmill.llm.byte_bpe import read_ranks  # noqa: E402
from corpusmill.llm.ngram_join import keep_one_of_each_group  # noqa: E402
from corpusmill.llm.quality_model import quality_report  # noqa: E402
from tests.llm.test_decontaminate import brute as contaminated  # noqa: E402
from tests.llm.test_line_dedup import brute as repeated  # noqa: E402
from tests.llm.test_ngram_join import brute as groups  # noqa: E402


def make():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(800)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    docs, labels, items = [], [], [(i, line(25)) for i in range(4)]
    passage = line(60)
    for i in range(150):
        text = "\n".join(line(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6)))
        good = rng.random() < 0.75
        if not good:
            text = " ".join(w + "%%%" for w in text.split(" "))
        elif rng.random() < 0.15:
            text += "\n" + passage
        elif rng.random() < 0.15:
            text += " " + rng.choice(items)[1]
        elif rng.random() < 0.2 and docs:
            words = rng.choice(docs)[1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs + [(200, docs[5][1], "en", "src0", 1), (201, None, None, None, None), (202, "", "en", "s", 0)], labels, items


def test_equals_brute_force(spark, tmp_path):
    docs, labels, items = make()
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(docs, schema, "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    good = {r.doc_id for r in quality_report(read("documents"), read("labels")).collect() if r.predicted}
    rows = [r for r in docs if r[0] in good]
    gone = repeated(rows, 50)
    cut = []
    for r in rows:
        lines = gone.get((r[0], r[1]), set())
        text = r[1] if not lines else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in lines)
        if not lines or text.strip():
            cut.append((r[0], text))
    one = {(i, n, c) for i, n, c in groups(cut, 5, 80, 100)}
    cut = [r for r in cut if any(i == r[0] and (c == i or not n) for i, n, c in one)]
    bad = {i for i, *_, hit in contaminated(cut, items) if hit}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in cut:
        if i not in bad:
            ids = ref.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want) and 40 < len(got) < len(good)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "x"), (1, text + " end", "x"), (None, text, "x"), (2, None, "x"), (2, None, "x"), (4, " ", "x"), (5, "other words here", "x"), (5, "other words here", "x"), (5, "not the same at all", "x"), (None, "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = keep_one_of_each_group(df)
    assert got.columns == df.columns
    want = [(1, text + " end", "x"), (2, None, "x"), (2, None, "x"), (4, " ", "x"), (5, "other words here", "x"), (5, "not the same at all", "x"), (None, "alone", "x")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts_that_stay_are_not_dealt(spark, tmp_path):
    """Bitmaps settle rows where they are: what is dealt with its text doesn't grow with the documents, and tables go once they are used."""
    from corpusmill.llm import shared

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    docs = [(i, text()) for i in range(300)]
    docs += [(1000, docs[7][1]), (8, docs[8][1]), (1009, docs[9][1] + " more"), (400, ""), (400, ""), (401, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    shared.release()
    out = keep_one_of_each_group(df)
    got = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert got == sorted((i, t or "") for i, t in docs[:300] + docs[-3:])
    df.write.parquet(str(tmp_path / "d"))
    plan = keep_one_of_each_group(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id#") == 2 and plan.splitlines()[0].startswith("Union")
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in shared._made}
    assert not left & {"buckets", "likely", "candidates", "pairs", "fragments", "placed", "large", "groups"}
    shared.release()
