import random
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm.reshard import place_blocks, reshard, write_shards


def test_copies_in_several_old_shards_reach_their_new_one(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 90))) for _ in range(600)]
    data = [(i, rng.choice(texts[:300]) if i % 2 else texts[300 + i % 300], rng.randrange(3)) for i in range(3000)]
    data += [(7000, "twice", 1), (7000, "twice", 1), (7000, "twice", 2), (None, None, 0), (None, "", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, at int")
    placed = reshard(df, shards=4, old=F.col("at"))
    got = placed.collect()
    # the old shard is the row's own
    assert Counter((r.doc_id, r.size, r.old) for r in got) == Counter((i, len(t or "") + 1, o) for i, t, o in data)
    homes = {}
    for r in got:
        homes.setdefault((r.h1, r.h2), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 0.05 * max(sizes.values())
    # every affected shard is written as a whole, each row once
    out = str(tmp_path / "new")
    affected = write_shards(df, placed, out)
    assert affected == sorted({s for r in got if r.old != r.shard for s in (r.old, r.shard)})
    written = spark.read.parquet(out).collect()
    assert len(written) == sum(r.shard in affected for r in got) == len(data)
    assert Counter((r.doc_id, r.text, r["at"]) for r in written) == Counter(data)
    assert Counter((r.doc_id, r._shard, r._slot) for r in written) == Counter((r.doc_id, r.shard, r.slot) for r in got)


def test_unaffected_shards_are_left_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i:03d}", i % 2) for i in range(100)], "doc_id long, text string, at int")
    placed = reshard(df, shards=2, old=F.col("at"))
    assert write_shards(df, placed, str(tmp_path / "none")) == []


def test_spread_blocks_cost_what_is_not_there():
    # blocks of home 0 that lie half in shard 1 leave shard 0 first
    blocks = [(i, 0, 10) for i in range(20)]
    to = place_blocks(blocks, [100, 100], {i: {0: 5, 1: 5} for i in range(10)})
    assert all((to[i] == 1) == (i < 10) for i in range(20))
