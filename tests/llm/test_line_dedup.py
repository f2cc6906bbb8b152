import hashlib
import random
import re

import pytest

from corpusmill.llm.line_dedup import dedup_lines, dedup_report

SCHEMA = "doc_id long, text string, cuts string, n_chars long"


def brute(rows, min_words):
    """Deleted line numbers per document, by comparing every pair of positions."""
    docs = sorted({(r[0] if r[0] is not None else -(2**63), r[1]) for r in rows if r[1] is not None}, key=lambda x: x[0])
    lines = [(d, t, i, x, len(re.findall(r"[^ \t\x0b\f\r]+", x))) for d, t in docs for i, x in enumerate(t.split("\n"))]
    gone = {}
    for p, (d, t, i, x, _) in enumerate(lines):
        for q in range(p):
            if lines[q][3] != x or (p and q and lines[p - 1][3] == lines[q - 1][3] and lines[p - 1][:2] == (d, t) and lines[q - 1][:2] == lines[q][:2]):
                continue  # not the first line of a run
            n = 0
            while p + n < len(lines) and lines[p + n][:2] == (d, t) and lines[q + n][:2] == lines[q][:2] and lines[p + n][3] == lines[q + n][3]:
                n += 1
            if sum(x[4] for x in lines[p : p + n]) >= min_words:
                gone.setdefault((d, t), set()).update(range(i, i + n))
    return gone


def report(rows, gone):
    out = []
    for r in rows:
        cut = gone.get((r[0] if r[0] is not None else -(2**63), r[1]), set())
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in cut)
        out.append((r[0], 0 if r[1] is None else r[1].count("\n") + 1, len(cut), None if kept is None else len(kept), None if kept is None else hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    pool = ["", " ", "a b", "c d e", "Ünï f", "g", "one line of six words here", "x y z w"]
    texts = []
    for _ in range(30):
        t = [rng.choice(pool) if rng.random() < 0.5 else f"u{rng.randrange(10**6)} v" for _ in range(rng.randrange(1, 14))]
        if texts and rng.random() < 0.6:
            src = rng.choice(texts).split("\n")
            a = rng.randrange(len(src))
            t[rng.randrange(len(t)) : 0] = src[a : a + rng.randrange(1, 9)]
        texts.append("\n".join(t))
    rows = [(i, t, None, len(t)) for i, t in enumerate(texts)]
    return rows + [(None, texts[3], "x", 1), (50, None, None, None), (51, "", "x", 0), (4, texts[4], "y", 9), (4, texts[4], "y", 9), (60, "\n".join(["a b"] * 23), None, 5), (61, texts[2], None, 5)]


@pytest.mark.parametrize("seed,min_words", [(1, 5), (2, 8), (3, 12)])
def test_equals_brute_force(spark, seed, min_words):
    rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    gone = brute(rows, min_words)
    assert any(gone.values())
    assert sorted(map(tuple, dedup_report(df, min_words).collect()), key=str) == report(rows, gone)
    out = dedup_lines(df, min_words)
    assert out.columns == df.columns
    lost = sum(1 for r in rows if r[1] is not None and (cut := gone.get((r[0] if r[0] is not None else -(2**63), r[1]))) and not "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in cut).strip(" "))
    assert out.count() == len(rows) - lost


def test_nothing_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", None, 5), (2, None, None, None)], SCHEMA)
    assert sorted(map(tuple, dedup_lines(df, 2).collect())) == [(1, "a b c", None, 5), (2, None, None, None)]
    assert dedup_report(df.limit(0)).count() == 0


def test_long_text(spark):
    body = "\n".join(f"line {i} of a long text" for i in range(3000))
    df = spark.createDataFrame([(1, body, None, 1), (2, "head\n" + body + "\ntail", None, 1)], SCHEMA)
    assert {(r.doc_id, r.n_removed) for r in dedup_report(df).collect()} == {(1, 0), (2, 3000)}
    assert [r.text for r in dedup_lines(df).where("doc_id = 2").collect()] == ["head\ntail"]
