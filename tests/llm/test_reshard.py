import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.reshard import min_cost_flow, place_blocks, reshard, reshard_report, write_shards

SCHEMA = "doc_id long, text string, shard string, size string"


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    supply = [rng.randrange(0, 4) for _ in range(3)]
    capacity = [rng.randrange(0, 5) for _ in range(3)]
    capacity[0] += max(0, sum(supply) - sum(capacity))
    cost = [[rng.randrange(0, 6) for _ in range(3)] for _ in range(3)]
    flow = min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
    best = min(
        sum(cost[i][j] for i, j in zip(units, to))
        for units in [[i for i, s in enumerate(supply) for _ in range(s)]]
        for to in itertools.product(range(3), repeat=len(units))
        if all(to.count(j) <= capacity[j] for j in range(3))
    )
    assert sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(3)) == best


def test_flow_without_room():
    with pytest.raises(ValueError):
        min_cost_flow([3], [2], [[0]])


def test_blocks_stay_where_they_can():
    blocks = [(i, i % 2, 10) for i in range(40)]
    to = place_blocks(blocks, [100, 100, 100, 100])
    sizes = [sum(10 for b in to.values() if b == j) for j in range(4)]
    assert sizes == [100] * 4 and sum(to[i] != i % 2 for i in range(40)) == 20


def rows(seed=1, n=4000):
    rng = random.Random(seed)
    out = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randrange(1, 200))), "x", None) for i in range(n)]
    out += [(n + i, "same text " * 4, None, "y") for i in range(300)]
    return out + [(None, None, None, None), (5, "", "q", None), (7, "dup", None, None), (7, "dup", None, None)]


def test_placement(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = reshard_report(df).collect()
    assert len(got) == len(data)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data if i is not None)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(8)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= 0.03 * max(sizes)
    homes = {}
    for r in got:
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    moved = sum(r.size for r in got if r.old_shard != r.shard)
    assert moved <= 1.1 * sum(sizes) * 2 / 8
    out = str(tmp_path / "moved")
    write_shards(df, reshard(df), out)
    assert spark.read.parquet(out).count() >= sum(r.old_shard != r.shard for r in got)


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    data = [(i, "same text", None, None) for i in range(3000)] + [(10_000 + i, f"other {i:4d}", None, None) for i in range(3000)]
    got = reshard(spark.createDataFrame(data, SCHEMA)).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.06 * max(sizes)


def test_given_old_shards_and_empty_table(spark):
    df = spark.createDataFrame(rows(2, 500), SCHEMA)
    got = reshard(df, shards=3, old=F.coalesce(F.col("doc_id") % 2, F.lit(0))).collect()
    assert len(got) == df.count() and {r.shard for r in got} == {0, 1, 2}
    assert reshard_report(df.limit(0)).count() == 0
