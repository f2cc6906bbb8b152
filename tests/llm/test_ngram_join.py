import random
import re

import numpy as np
import pytest

from corpusmill.llm.ngram_join import Plan, ngram_jaccard_join, shared_least, signatures

SCHEMA = "doc_id long, text string, cls string, n long"


def brute(rows, k=4, num=85, den=100):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


def corpus(seed, copies=40, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choice(vocab) for _ in range(150)]
    for i in range(n):
        rows.append([rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 7, 12, 30, 80]))])
    for i in range(copies):  # a group of near copies, of which some pairs link
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append(t)
        rows.append(list(rng.choice(rows)))
        t = list(rng.choice(rows))
        rows.append(t[:-1] or t)
    rng.shuffle(rows)
    return [(i, " \n\t"[i % 3].join(t).title(), None, i) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"part": 32, "block": 2000})])
def test_equals_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(5), **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, "  \n", "a", None), (4, "one Two", "a", 1), (4, "one two", "a", 1), (None, "ONE TWO", "a", 1), (7, "é É x", None, 1), (8, "É É x", None, 1), (None, None, None, None), (9, "word " * 20000, "a", 1), (10, "word " * 10, "a", 1)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    got = ngram_jaccard_join(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0


@pytest.mark.parametrize("num", [80, 85, 95])
def test_linked_sets_share_the_signatures_that_they_must(num):
    plan = Plan(num, 100)
    rng = np.random.default_rng(num)
    for n in [*range(1, 40), 75, 120, 121, 400]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            if rng.random() < 0.3:  # crowded into few fragments
                a = np.unique(a >> np.uint64(rng.integers(1, 12)))
            cut = rng.integers(0, len(a) + 1 - int(np.ceil(num * len(a) / 100)))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) * (100 - num) // 100)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < num * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            sa, sb = (signatures(x, plan) for x in (a, b))
            shared = np.intersect1d(sa, sb)
            assert len(shared)
            level = {int(x) & 127 for x in shared}
            for x in (a, b):
                least = {r["level"]: r["least"] for r in shared_least(x, plan)}
                assert all(sum(int(y) & 127 == k for y in shared) >= least[k] for k in level if k == max(set(least) & {r["level"] for r in shared_least(b if x is a else a, plan)}))
