import hashlib
import random
import re

import pytest

from corpusmill.llm.decontaminate import decontamination_report, drop_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for row in docs:
        w, hit, ids = tokens(row[1]), set(), set()
        for item, text in items:
            p = tokens(text)
            size = min(window, len(p))
            for k in range(len(p) - size + 1) if size else ():
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == p[k : k + size]:
                        hit.update(range(i, i + size))
                        ids.add(str(item) if item is not None else None)
        ids.discard(None)
        out.append((row[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    vocab = ["é", "Alpha", "beta", "g4", "x"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(n))
    docs = []
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(8)] + [(None, text(12)), (3, text(12)), (20, None)]
    for i in range(60):
        t = text(rng.choice([0, 4, 20, 60]))
        if rng.random() < 0.5:
            t += (rng.choice(items)[1] or "") + text(5)
        docs.append((i, t, "z"))
    return docs + [(None, None, None), (5, "", "z"), (7, docs[0][1], "q"), (7, docs[0][1], "q")], items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = make(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination_report(d, b).collect()), key=str)
    assert got == brute(docs, items)
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[-1] for x in got)


def test_several_matchers(spark, monkeypatch):
    from corpusmill.llm import decontaminate

    docs, items = make(9)
    monkeypatch.setattr(decontaminate, "MATCHER_BYTES", 150)
    monkeypatch.setattr(decontaminate.benchmark_spans, "__defaults__", (10, "text", 150))
    got = decontamination_report(spark.createDataFrame(docs, "doc_id long, text string, n_words long".replace("n_words long", "n_words string")), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontamination_report(d, b).first()[1:4] == (2, 0, 0)
    assert decontamination_report(d.limit(0), b).count() == 0


def test_long_text(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(500)}" for _ in range(300_000)]
    item = " ".join(w[123_456:123_480])
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    row = decontamination_report(d, spark.createDataFrame([("a", item)], "item_id string, text string")).first()
    assert row.n_words == 300_000 and row.n_hit == 24 and row.n_items == 1
