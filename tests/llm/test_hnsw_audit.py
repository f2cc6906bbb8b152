import numpy as np
import pytest

from corpusmill.llm.hnsw_dedup import BEAMS, Graph, search_shard, unit, vector_links


class Blind(Graph):
    """A graph whose searches find nothing by the first beam."""

    def within(self, q, least, beam, own=None):
        return np.zeros((len(q), len(self.v)), dtype=bool) if beam <= BEAMS[0] else super().within(q, least, beam, own)


@pytest.mark.parametrize("links", [1, 5, 90])
def test_few_links_are_audited(links):
    v = np.random.default_rng(2).normal(size=(700, 32))
    v[600 : 600 + links] = v[:links] + 1e-3
    hits, beam, audited, true, recall = search_shard(unit(v), Blind(unit(v)), 0.93)
    assert hits.sum() == 2 * links and beam > BEAMS[0] and recall == 1 and true > 0
    assert links >= 64 or audited == 700


def test_no_links_is_no_recall():
    v = unit(np.random.default_rng(3).normal(size=(300, 32)))
    hits, beam, audited, true, recall = search_shard(v, Graph(v), 0.93)
    assert not hits.any() and audited == 300 and true == 0 and recall is None


def test_audits_between_shards(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1200, 24))
    v[600:900] = v[:300] + rng.normal(size=(300, 24)) * 0.05
    rows = [(i, v[i].tolist(), i // 1000) for i in range(1200)]  # the second label has no links within itself
    ids, found, audits = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=100)
    last = {}
    for r in sorted(audits.where("shard is null").collect(), key=lambda r: r["round"]):
        last[r.label] = r
    assert set(last) == {0, 1}
    assert last[0].true_links > 0 and last[0].recall >= 0.97 and last[0].audited > 100
    assert last[1].true_links == 0 and last[1].recall is None and last[1].audited > 0


def test_all_rounds_fail_but_the_exhaustive_one(spark, monkeypatch):
    import corpusmill.llm.hnsw_dedup as h

    monkeypatch.setattr(h, "ROUNDS", ((1, 0.0), (2, 1e-6), (None, None)))
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24))
    v[300:] = v[:300] + rng.normal(size=(300, 24)) * 0.12
    rows = [(i, v[i].tolist(), 1) for i in range(600)]
    _, found, audits = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60)
    u = unit(v)
    true = u @ u.T >= 0.93
    np.fill_diagonal(true, False)
    got = found.where("kind = 'count'").groupBy().sum("n").first()[0]
    assert [r.recall for r in audits.where("round = 3").collect()] == [1.0] and got >= 0.97 * true.sum() and got <= true.sum()


def test_an_audit_without_links_does_not_pass(spark, monkeypatch):
    """One link, between shards, which the drawn queries don't see: the search goes on to the exhaustive round."""
    import corpusmill.llm.hnsw_dedup as h

    monkeypatch.setattr(h, "DRAWN", 4)
    monkeypatch.setattr(h, "ROUNDS", ((1, 0.0), (2, 1e-6), (None, None)))
    apart = 0
    for seed in range(6, 12):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(400, 24))
        v[399] = v[0] + rng.normal(size=24) * 0.33
        u = unit(v)
        if u[0] @ u[399] < 0.93:
            continue
        rows = [(i, v[i].tolist(), 1) for i in range(400)]
        _, found, audits = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=40)
        told = audits.collect()
        if any(r.true_links for r in told if r.shard is not None):
            continue  # in one shard
        apart += 1
        seen = [r.recall for r in told if r.shard is None and r["round"] < 3]
        assert found.where("kind = 'count'").groupBy().sum("n").first()[0] == 2 and all(x is None or x < 0.97 for x in seen)
        break
    assert apart


def test_components_of_any_size(spark):
    from corpusmill.llm.hnsw_dedup import embedding_near_dedup

    a, b = [1.0, 2.0, -3.0, 0.5], [1.0, 2.01, -3.0, 0.5]
    scales = (1e200, 1e-200, 5e-320, 1.7e307, 1.0)
    rows = [(2 * i + j, [x * s for x in v], i) for i, s in enumerate(scales) for j, v in enumerate((a, b))]
    got = embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, 1, k - k % 2) for k in range(10)]
