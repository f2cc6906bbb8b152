"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Documents are gathered in blocks; equal texts share a block. A block lies in one
old shard, or holds groups of equal texts that are spread over several and have
most of their bytes in the same one, their home. A flow network from old shard
sizes to new capacities, where only bytes that change shard cost, says how many
bytes each pair of shards exchanges, and whole blocks are chosen to carry them.
Shards end near equal in bytes.

Only tables of a bounded number of rows reach the driver: one row per block and
old shard, and blocks are at most ``2 * BUCKETS`` per old shard and a few per
large group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, new_folder, quoted

#: Buckets of small groups per old shard.
BUCKETS = 512
#: A group of equal texts of more than this part of a new shard is a block of its own;
#: of more than HALF of one, it is dealt out over several.
LARGE, HALF = 256, 2
#: Cost of a byte that changes shard.
UNIT = 1000
#: Rows of a block that one task numbers.
RUN = 50_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from supplies to capacities of the least total cost (successive shortest paths)."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)  # potentials keep reduced costs from being negative
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        before: list[int | None] = [None] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < n:
                steps = [(n + j, cost[v][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][v - n]) for i in range(n) if flow[i][v - n]]
            for u, c in steps:
                if (e := d + c + high[v] - high[u]) < dist[u]:
                    dist[u], before[u] = e, v
                    heapq.heappush(heap, (e, u))
        end = min((v for v in range(n, n + m) if room[v - n]), key=lambda v: dist[v] + high[v])
        path = [end]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        amount = min([left[path[-1]], room[end - n]] + [flow[a][b - n] for b, a in zip(path[1:], path[:-1], strict=True) if b >= n])
        for b, a in zip(path[:-1], path[1:], strict=True):  # from a to b
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[-1]] -= amount
        room[end - n] -= amount
        top = max(d for d in dist if d < float("inf"))
        high = [h + min(d, top) for h, d in zip(high, dist, strict=True)]
    return flow


def place_blocks(blocks: list[tuple[int, int, int]], capacity: list[int], spread: dict[int, dict[int, int]] | None = None) -> dict[int, int]:
    """New shard of every block ``(block, old shard, bytes)``.

    The flow fixes how many bytes go from each old shard to each new one; the
    blocks of an old shard are dealt out, the largest first, to the new shard
    that lacks the most of its share. New shard ``i`` is old shard ``i``.

    ``spread`` has the bytes by old shard of blocks that lie in several. They
    are supplies of their own, by home, and cost what is not yet in a new shard.
    """
    spread = spread or {}
    olds = max((o for _, o, _ in blocks), default=-1) + 1
    m = len(capacity)
    source = {block: olds + o if block in spread else o for block, o, _ in blocks}
    supply, there = [0] * (2 * olds), [[0] * m for _ in range(2 * olds)]
    for block, o, size in blocks:
        supply[source[block]] += size
        for old, part in spread.get(block, {o: size}).items():
            if old < m:
                there[source[block]][old] += part
    cost = [[UNIT - UNIT * there[i][j] // max(supply[i], 1) for j in range(m)] for i in range(2 * olds)]
    flow = min_cost_flow(supply, capacity, cost)
    out = {}
    for block, o, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        row, own = flow[source[block]], spread.get(block)
        if own is None:
            to = max(range(m), key=lambda j: (row[j], j == o, -j))
        else:  # where most of it lies, of those that lack as much
            to = max(range(m), key=lambda j: (own.get(j, 0) if row[j] >= size else -1, row[j], -j))
        row[to] -= size
        out[block] = to
    return out


def _digest(docs: DataFrame, old: Column | None, old_shards: int, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"), *([old.cast("int").alias("old")] if old is not None else []))
    return rows if old is not None else rows.withColumn("old", F.pmod("h2", F.lit(old_shards)).cast("int"))


def reshard(docs: DataFrame, shards: int = 8, old_shards: int = 6, old: Column | None = None, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, h1, h2, old, shard, slot, dealt`` of every row; ``h1, h2`` are hashes of its text.

    ``old`` is a row's present shard (0, 1, ..., not null); without it, rows count as
    dealt to ``old_shards`` by a hash of their text. Size is the UTF-8 bytes of
    the text (none for null) plus one, and the law is bytes: shards are equal up
    to a block, about 1/500 of an old shard, or the largest document.

    Equal texts go to one shard (null counts as an empty text), unless together
    they are larger than half a shard: such a group is dealt out by ``doc_id``,
    and ``dealt`` says so.
    Repeated rows are rows of their own. Slots count from 0 within a shard
    without gaps. An empty table gives an empty result.
    """
    rows = materialize(_digest(docs, old, old_shards, text), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    part = max(1, total // shards)

    if old is None:
        groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.min("old").alias("home"))
    else:  # the home of a group has most of its bytes
        parts = rows.groupBy("h1", "h2", "old").agg(F.sum("size").alias("part"))
        groups = parts.groupBy("h1", "h2").agg(F.sum("part").alias("bytes"), (-F.max(F.struct("part", (-F.col("old")).alias("o")))["o"]).alias("home"), (F.count("*") > 1).alias("mixed"))
    # at most LARGE * shards groups are that large
    large = groups.where(F.col("bytes") * LARGE > part).withColumn("ways", F.when(F.col("bytes") * HALF > part, F.ceil(F.col("bytes") * LARGE / part)).otherwise(1).cast("long"))
    large = materialize(large.select("h1", "h2", F.col("home").alias("large_home"), "ways"), "large")
    if old is None:
        placed = rows.withColumn("home", F.col("old")).withColumn("mixed", F.lit(False))
    else:
        placed = rows.join(groups.select("h1", "h2", "home", "mixed"), ["h1", "h2"])
    placed = placed.join(F.broadcast(large), ["h1", "h2"], "left")
    if old is not None:  # what is dealt out need not leave its shard
        dealt = F.coalesce(F.col("ways") > 1, F.lit(False))
        placed = placed.withColumn("home", F.when(dealt, F.col("old")).otherwise(F.col("home"))).withColumn("mixed", F.col("mixed") & ~dealt)
    alone = F.concat_ws(":", F.lit("g"), "h1", "h2", F.pmod(F.xxhash64("doc_id", "size", F.lit(3)), F.greatest("ways", F.lit(1))), *(["home"] if old is not None else []))
    key = F.when(F.col("ways").isNull(), F.concat_ws(":", F.when(F.col("mixed"), "m").otherwise("b"), "home", F.pmod("h1", F.lit(BUCKETS)))).otherwise(alone)
    placed = placed.select("doc_id", "size", "text_crc32", "h1", "h2", "old", "home", "mixed", key.alias("key"), F.coalesce(F.col("ways") > 1, F.lit(False)).alias("dealt"))
    placed = materialize(placed, "placed")

    parts = placed.groupBy("key", "home", "mixed", "old").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("key", "old").toPandas()
    blocks = parts.groupby("key", as_index=False, sort=False).agg(home=("home", "first"), mixed=("mixed", "first"), bytes=("bytes", "sum"), n=("n", "sum"))
    number = {k: i for i, k in enumerate(blocks["key"])}
    spread: dict[int, dict[int, int]] = {}
    for r in parts[parts["mixed"]].itertuples():
        spread.setdefault(number[r.key], {})[int(r.old)] = int(r.bytes)
    capacity = [total // shards + (i < total % shards) for i in range(shards)]
    to = place_blocks(list(zip(range(len(blocks)), blocks["home"].tolist(), blocks["bytes"].tolist(), strict=True)), capacity, spread)
    blocks["shard"] = [to[i] for i in range(len(blocks))]
    blocks["runs"] = -(-blocks["n"] // RUN)
    spark = docs.sparkSession
    where = spark.createDataFrame(blocks[["key", "shard", "runs"]].values.tolist(), "key string, shard int, runs long")

    # rows are numbered in runs of a bounded number; the runs of a shard follow one another
    placed = placed.join(F.broadcast(where), "key").withColumn("run", F.pmod(F.xxhash64("doc_id", "h1", F.lit(5)), F.col("runs")))
    placed = placed.select("doc_id", "size", "text_crc32", "old", "shard", "key", "run", "h1", "h2", "dealt")
    counts = placed.groupBy("shard", "key", "run").agg(F.count("*").alias("n"))
    begin = counts.withColumn("begin", F.sum("n").over(Window.partitionBy("shard").orderBy("key", "run").rowsBetween(Window.unboundedPreceding, -1)))
    begin = begin.select("key", "run", F.coalesce("begin", F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("key", "run").orderBy("h1", "h2", "doc_id", "size"))
    return placed.withColumn("nth", nth).join(begin, ["key", "run"]).select("doc_id", "size", "text_crc32", "h1", "h2", "old", "shard", (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot"), "dealt")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write every shard that gains or loses rows, as a whole, one folder each, to the new folder ``path``.

    ``placed`` is what ``reshard`` made of ``docs``. Returns the shards that are
    affected; one of them without a folder has no rows any more. Rows that repeat
    are written as often as they are there, nulls and columns of any names as
    they are; ``_old``, ``_shard``, ``_slot`` and ``_dealt`` are added and must
    not be among them.
    """
    changed = placed.where("old <> shard")
    affected = sorted(r[0] for r in changed.select("shard").union(changed.select("old")).distinct().collect())
    keys = ["_id", "_h1", "_h2"]
    new = placed.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("old").alias("_old"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("dealt").alias("_dealt"))
    place = ["_old", "_shard", "_slot", "_dealt"]
    first = new.groupBy(keys).agg(F.count("*").alias("_times"), *(F.min(c).alias(c) for c in place))
    t = F.coalesce(F.col(*quoted("text")), F.lit(""))
    own = docs.select("*", F.col("doc_id").alias("_id"), F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(7), t).alias("_h2"))
    both = own.join(first, own["_id"].eqNullSafe(first["_id"]) & (own["_h1"] == first["_h1"]) & (own["_h2"] == first["_h2"])).drop(first["_id"], first["_h1"], first["_h2"])
    columns = quoted(*docs.columns)
    single = both.where("_times = 1").select(*columns, *place)
    # rows of equal ids and texts are numbered on both sides and meet one to one
    nth = lambda by: F.row_number().over(Window.partitionBy(keys).orderBy(by))
    whole = F.xxhash64(*(c for c, (_, kind) in zip(columns, docs.dtypes, strict=True) if "map<" not in kind and kind != "variant"))
    copies = both.where("_times > 1").drop(*place).withColumn("_nth", nth(whole))
    places = new.withColumn("_nth", nth(F.struct("_shard", "_slot")))
    same = [copies[k].eqNullSafe(places[k]) for k in [*keys, "_nth"]]
    copies = copies.join(places, same[0] & same[1] & same[2] & same[3]).select(*(copies[c] for c in columns), *place)
    single.unionByName(copies).where(F.col("_shard").isin(affected)).write.partitionBy("_shard").parquet(path)
    return affected


def reshard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, group_dealt`` of every row, from the rewritten files.

    Affected shards are written as files; their rows, sizes and checksums are
    read from there, those of unaffected shards from the documents. The law is
    bytes; ``grown_shard`` belongs to another law and is null. ``group_dealt``
    marks copies of a text that together are larger than half a shard and are
    dealt over several. Null texts have size 1. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    placed = materialize(reshard(docs, shards), "shards")
    path = new_folder(spark, "rewritten")
    affected = write_shards(docs, placed, path)
    t = F.coalesce(F.col("text"), F.lit(""))
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "old", "dealt"]
    out = placed.where(~F.col("shard").isin(affected)).select(*names)
    if affected:
        kind = docs.schema["doc_id"].dataType.simpleString()
        files = spark.read.schema(f"doc_id {kind}, text string, _old int, _slot long, _dealt boolean, _shard int").parquet(path)
        files = files.select("doc_id", (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_old").alias("old"), F.col("_dealt").alias("dealt"))
        out = files.unionByName(out)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), F.col("dealt").alias("group_dealt"))
