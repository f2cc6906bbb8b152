import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import maxent_lm
from corpusmill.llm.maxent_lm import END, fit, lm_report, log_softmax, score_texts, tokens

SCHEMA = "doc_id long, text string, score string, c long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(n=240):
    rng = random.Random(5)
    tongues = [[f"{p}{rng.randrange(400)}{p}" for _ in range(150)] for p in ("ka", "Mo", "é", "zu")]
    rows = []
    for i in range(n):
        vocab = rng.choice(tongues)
        rows.append((i, " ".join(vocab[min(int(rng.expovariate(0.03)), 149)] for _ in range(rng.randrange(1, 120))), None, i))
    return rows + [(None, None, "x", None), (n, "", None, 1), (n + 1, "new words only" + "!" * 9, None, 1), (3, rows[3][1], None, 3), (3, rows[3][1], None, 3)]


def brute(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in rows if not out(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(w := split(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t, *_ in rows), key=str)


def ids_of(texts, model):
    h, tails, at = tokens(texts)
    return model.vocabulary.ids(model.vocabulary.ranks(h), tails), at


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_base_is_exact_and_the_model_better(spark, monkeypatch, hot):
    monkeypatch.setattr(maxent_lm, "HOT", hot)
    rows = make()
    got = lm_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    rows = make(60)
    model, vocab = fit(spark.createDataFrame(rows, SCHEMA))
    f = maxent_lm.Features(*ids_of([b"ka1ka mo2mo unseen"], model), model.classes)
    assert np.allclose(np.exp(log_softmax(model.weights, model.bias, f.rows)).sum(1), 1, atol=1e-5)
    share = Counter()
    end = int(END.view(np.int64)[0])
    own = {int(h): i for i, h in enumerate(model.vocabulary.h[:-1][: maxent_lm.OWN].view(np.int64))}
    for r in vocab.collect():
        k = 0 if r.h == end else int(model.classes[own.get(r.h, maxent_lm.OWN + r.tail)])
        share[k] += (r.c + 0.5) / 10 ** model.log_size[k]
    assert share[0] == pytest.approx(1) and all(share[k] + 0.5 / 10 ** model.log_size[k] == pytest.approx(1) for k in share if k)


def test_scores_do_not_depend_on_the_batch(spark):
    rows = make(60)
    model, _ = fit(spark.createDataFrame(rows, SCHEMA))
    texts = [(t or "").encode() for _, t, *_ in rows]
    both = score_texts(texts, model)
    for i in (0, 7, 60, 61, 62):
        one = score_texts([texts[i]], model)
        assert one[0][0] == both[0][i] and one[3][0] == pytest.approx(both[3][i])


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FAN", 2)
    monkeypatch.setattr(maxent_lm, "SHARE", 500)
    rows = make(150)
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    one, many = (sorted(lm_report(d).collect(), key=key) for d in (df.coalesce(1), df.repartition(9)))
    assert all(a.score == pytest.approx(b.score, abs=1e-3) and a.base_score == pytest.approx(b.base_score) for a, b in zip(one, many, strict=True))


def test_gradient_equals_brute_force(spark):
    rows = make(40)
    model, _ = fit(spark.createDataFrame(rows, SCHEMA))
    texts = [(t or "").encode() for _, t, *_ in rows]
    f = maxent_lm.Features(*ids_of(texts, model), model.classes)
    seen, wanted = np.zeros((2, maxent_lm.ROWS, maxent_lm.CLASSES))
    for t in range(len(f.cls)):
        z = model.bias + sum(model.weights[f.rows[t, k]] for k in range(maxent_lm.KINDS))
        p = np.exp(z - z.max())
        for k in range(maxent_lm.KINDS):
            seen[f.rows[t, k], f.cls[t]] += 1
            wanted[f.rows[t, k]] += p / p.sum()
    parts = [ids_of(texts[:20], model), ids_of(texts[20:], model)]
    assert (maxent_lm.seen(model.classes, parts) == seen).all()
    assert np.allclose(maxent_lm.expected(model.classes, model.weights, model.bias, parts), wanted, atol=1e-3)


def test_rounds_raise_the_likelihood_of_training_texts(spark, monkeypatch):
    df = spark.createDataFrame(make(150), SCHEMA)
    of = lambda: sum(r.score for r in lm_report(df).collect() if not r.held_out)
    totals = []
    for rounds in (1, 2, 4):
        monkeypatch.setattr(maxent_lm, "ROUNDS", rounds)
        totals.append(of())
    assert totals == sorted(totals)


def test_ties_in_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HOT", 30)
    vocab = spark.createDataFrame([(i, 0, 5 if i < 10 else 1) for i in range(1000)], "h long, tail int, c long")
    got = maxent_lm._vocabulary(vocab)
    assert 10 <= len(got.h) - 1 <= 60 and (got.c[:10] == 5).all()


def test_tokens():
    h, tails, at = tokens([b"", b"A b\na", b" "])
    assert at.tolist() == [0, 1, 5, 6] and (h == END[0]).tolist() == [True, False, False, False, True, True]
    assert h[1] == h[3] != h[2] and tails[1] == tails[3]


def test_empty_table(spark):
    assert lm_report(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a b", None, 1)], SCHEMA)
    row = lm_report(only).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score < 0
