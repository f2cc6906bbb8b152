import numpy as np
import pytest

from corpusmill.llm.hnsw_dedup import Graph, embedding_near_dedup, search_shard, unit

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def vectors(seed, n=400, d=16, groups=30):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, d))
    v = base[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.15, 0.3, 2], n)[:, None]
    v[n // 2 : n // 2 + 20] = v[3]
    return v.astype(np.float32).astype(np.float64)


def brute(rows, least):
    def good(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_graph_recall(seed):
    v = unit(vectors(seed, 1500, 24))
    a, b = v[:700], v[700:]
    true = a @ b.T >= 0.93
    hits = Graph(b).within(a, 0.93, 48)
    assert (hits & true).sum() >= 0.97 * true.sum() and not (hits & (a @ b.T < 0.92999)).any()
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    hits, _, _, _, recall = search_shard(v, Graph(v), 0.93)
    assert not (hits & ~true).any() and hits.sum() >= 0.97 * true.sum() and recall >= 0.97


def test_equals_brute_force(spark):
    v = vectors(7)
    rows = [(i, v[i].tolist(), i % 3, None) for i in range(len(v))]
    rows += [(500, None, 1, "x"), (501, [0.0] * 16, 1, None), (502, [1.0, None] + [0.0] * 14, 1, None), (503, [float("nan")] * 16, 1, None), (504, v[0].tolist(), None, None), (None, v[1].tolist(), 1, None), (1, v[1].tolist(), 1, None), (505, v[1][:8].tolist(), 1, None), (506, [], 1, None), (507, [float("inf")] * 16, 1, None)]
    got = embedding_near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), shard=60)
    got, want = sorted(map(tuple, got.collect()), key=str), brute(rows, 0.93)
    assert len(got) == len(want)
    # the graphs are approximate; the audits ask for nearly all links
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True) if a[0] == b[0] and a[0] is not None and a[0] != 1)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_all_in_one_tight_group(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.02
    got = embedding_near_dedup(spark.createDataFrame([(i, v[i].tolist(), 1, None) for i in range(900)], SCHEMA), shard=100).collect()
    assert all(r.n_links == 899 and r.component_id == 0 for r in got)


def test_empty_table(spark):
    assert embedding_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    one = embedding_near_dedup(spark.createDataFrame([(5, [1.0, 0.0], 1, None)], SCHEMA)).collect()
    assert list(map(tuple, one)) == [(5, 0, 5, True)]
