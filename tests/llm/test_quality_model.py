import random
import zlib

import numpy as np
import pytest

from corpusmill.llm.quality_model import NAMES, _isotonic, drop_low_quality, quality_report, statistics

SCHEMA = "doc_id long, text string, score string, quality string"


def make(n=600):
    rng = random.Random(4)
    vocab = ["the", "of", "river", "Mountain", "sleeps", "ünder", "a", "bright", "sky", "and"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            w = [x + rng.choice(["%%%", "###", "$$$"]) for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w) + ".", "x", None))
        if i % 2:
            labels.append((i, int(good), 0))
    good = {i: q for i, q, _ in labels}
    return docs + [(None, None, None, None), (n, "", None, None), (n + 1, "word " * 30000, None, None), (1, docs[1][1], None, None)], labels + [(None, 1, 0), (3, None, 1), (9999, 0, 0)], good


def test_held_out_accuracy(spark):
    docs, labels, good = make()
    d, t = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality_report(d, t).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(r.predicted, good[r.doc_id]) for r in rows if r.held_out and r.doc_id in good]
    assert np.mean([a == b for a, b in test]) > 0.93
    kept = drop_low_quality(d, t)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in rows)


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b", None, None)], SCHEMA)
    t = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_report(d, t).first().score == 0.5
    assert quality_report(d.limit(0), t).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert 0 <= quality_report(d, one).first().score <= 1


def test_statistics_are_of_each_text_alone():
    texts = [b"", b"One two  two.", "É é %%% !!".encode(), b"\n", b"A" * 50_000]
    both = statistics(texts)
    assert both.shape == (5, len(NAMES))
    for i, t in enumerate(texts):
        assert np.allclose(both[i], statistics([t])[0])
    assert not both[0].any() and np.isfinite(both).all()


@pytest.mark.parametrize("seed", range(3))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    x, y, n = np.arange(40.0), rng.random(40), rng.integers(1, 5, 40).astype(float)
    px, py = _isotonic(x, y, n)
    assert (np.diff(py) > 0).all() and (np.diff(px) > 0).all()
    mean = lambda a, b: np.average(y[a:b], weights=n[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    pools = np.unique(np.round(want, 9))
    assert np.allclose(py, pools)
