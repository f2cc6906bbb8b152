"""Property graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_name
from ..session import FREED, settings
from . import postings


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Union of edge tables ``(src, dst, type)`` without parallel edges."""
    out = edges[0].select("src", "dst", "type")
    for e in edges[1:]:
        out = out.unionByName(e.select("src", "dst", "type"))
    return out.where("src is not null and dst is not null").dropDuplicates(["src", "dst", "type"])


def merge_nodes(*nodes: DataFrame) -> DataFrame:
    """Union of node tables ``(id, label, name)``, one row per id and label."""
    out = nodes[0].select("id", "label", "name")
    for n in nodes[1:]:
        out = out.unionByName(n.select("id", "label", "name"))
    return out.groupBy("id", "label").agg(F.min("name").alias("name"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def expand(start: DataFrame, edges: DataFrame, *, query: str = "query_id", node: str = "node", corresponds: str = "CORRESPONDS_TO", refers: str = "REFERS_TO", discusses: str = "DISCUSSES", nodes: DataFrame | None = None) -> DataFrame:
    """Per query the neighbours of its nodes: corresponding ones in both directions, references and concepts onward.

    All are sorted and distinct; ``all_sections`` also has the nodes themselves,
    which is what an empty graph gives. Concepts go by their names where ``nodes`` are given.
    """
    pair = both_ways(edges.where(F.col("type") == corresponds)).select("src", "dst", F.lit("c").alias("k"))
    on = edges.where(F.col("type").isin(refers, discusses)).select("src", F.col("dst"), F.when(F.col("type") == refers, "r").otherwise("d").alias("k"))
    if nodes is not None:
        names = nodes.select(F.col("id").alias("dst"), "name")
        on = on.join(names, "dst", "left").select("src", F.when(F.col("k") == "d", F.coalesce("name", "dst")).otherwise(F.col("dst")).alias("dst"), "k")
    hops = start.select(query, F.col(node).alias("src")).join(pair.unionByName(on), "src").select(query, "dst", "k")
    rows = hops.unionByName(start.select(query, F.col(node).alias("dst"), F.lit("s").alias("k")))
    of = lambda *k: F.array_sort(F.collect_set(F.when(F.col("k").isin(*k), F.col("dst"))))
    return rows.groupBy(query).agg(of("c").alias("corresponds"), of("r").alias("refers"), of("d").alias("concepts"), of("s", "c", "r").alias("all_sections"))


#: What writes a table and returns it as it was read back.
Keep = Callable[[DataFrame], DataFrame]


def reach(start: DataFrame, edges: DataFrame, depth: int = 3, *, query: str = "query_id", node: str = "node", into: DataFrame | None = None, keep: Keep | None = None) -> DataFrame:
    """``(query, node, hop)``: nodes within ``depth`` steps in either direction, at their first step, without the start.

    Every step joins the nodes of the step before, each once per query; the first
    step at which a node is met is told at the end, in one aggregation. Only those
    ``into(node)`` are told, if given: then the last step takes only edges that
    end in one, and doesn't fan out from a node that everything has in common.
    ``keep`` gives a table back as it was written, so that no step is taken twice.
    """
    keep = keep or (lambda rows: rows)
    step = keep(both_ways(edges.select("src", "dst")).distinct())
    front = start.select(query, F.col(node).alias("node")).distinct()
    met = front.withColumn("hop", F.lit(0))
    wanted = None if into is None else into.select("node").distinct()
    for hop in range(1, depth + 1):
        taken = step if hop < depth or wanted is None else step.join(wanted.select(F.col("node").alias("dst")), "dst", "left_semi")
        front = front.select(query, F.col("node").alias("src")).join(taken, "src").select(query, F.col("dst").alias("node")).distinct()
        front = keep(front)
        met = met.unionByName(front.withColumn("hop", F.lit(hop)))
    out = met.groupBy(query, "node").agg(F.min("hop").alias("hop")).where("hop > 0")
    return out if wanted is None else out.join(wanted, "node", "left_semi").select(query, "node", "hop")


#: 64-bit words of a block of queries, whose nodes are met together, a bit for each query.
WORDS = 8
#: Bytes of a graph, and of a walk in it, that a task may hold; steps of a pack of them.
HELD, PACK = 1_500_000_000, 1_000_000


def _in_order(values: DataFrame, path: str) -> DataFrame:
    """The distinct values of a column ``v`` with numbers ``n`` in the same order, written to ``path``."""
    kind = values.schema["v"].dataType.simpleString()
    values.select("v").distinct().orderBy("v").withColumn("n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return values.sparkSession.read.schema(f"v {kind}, n long").parquet(path)


def _walked(start: DataFrame, edges: DataFrame, depth: int, path: str, query: str, node: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by block of queries and first step, and the tables of queries and of nodes.

    Nodes are numbers in the order of their ids. A row holds the queries of a block
    that meet a node at a step, one bit each, so a step moves an edge once for all
    of these; the steps are written to ``path`` by ``hop``, what they need beside it.
    """
    spark = start.sparkSession
    start, pairs = start.select(F.col(query).alias("q"), F.col(node).alias("v")).distinct(), both_ways(edges.select("src", "dst"))
    names = _in_order(edges.select(F.explode(F.array("src", "dst")).alias("v")).unionByName(start.select("v")), f"{path}-nodes")
    held = start.select("q").distinct().count()
    asked = start.select("q").distinct().orderBy("q").coalesce(-(-held // 1_000_000) or 1).withColumn("at", F.monotonically_increasing_id())
    asked = asked.select("q", F.expr(f"shiftright(at, 6) div {WORDS}").alias("block"), F.expr(f"cast(shiftright(at, 6) % {WORDS} as int)").alias("word"), F.expr("cast(at % 64 as int)").alias("bit"))
    asked.write.mode("overwrite").parquet(f"{path}-queries")
    queries = spark.read.schema(asked.schema).parquet(f"{path}-queries")
    of = lambda side: names.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"))
    pairs.join(of("src"), "src").join(of("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")).distinct().write.mode("overwrite").parquet(f"{path}-steps")
    step = spark.read.schema("src long, dst long").parquet(f"{path}-steps")
    words = [f"w{i}" for i in range(WORDS)]
    schema = "block long, node long, " + ", ".join(f"{w} long" for w in words) + ", hop int"
    first = start.join(queries, "q").join(names, "v").groupBy("block", F.col("n").alias("node"))
    first.agg(*(F.expr(f"bit_or(if(word = {i}, shiftleft(1L, bit), 0L))").alias(w) for i, w in enumerate(words))).write.mode("overwrite").parquet(f"{path}/hop=0")
    for hop in range(1, depth + 1):
        met = spark.read.schema(schema).parquet(path)
        moved = met.where(F.col("hop") == hop - 1).withColumnRenamed("node", "src").join(step, "src").select("block", F.col("dst").alias("node"), *words, F.lit(True).alias("fresh"))
        both = moved.unionByName(met.select("block", "node", *words, F.lit(False).alias("fresh"))).groupBy("block", "node")
        new = both.agg(*(F.expr(f"bit_or(if(fresh, {w}, 0L)) & ~bit_or(if(fresh, 0L, {w}))").alias(w) for w in words)).where(" or ".join(f"{w} != 0" for w in words))
        new.write.mode("overwrite").parquet(f"{path}/hop={hop}")
        if spark.read.schema(schema).parquet(path).where(F.col("hop") == hop).isEmpty():
            break
    return spark.read.schema(schema).parquet(path).where("hop > 0"), queries, names


def _by_query(met: DataFrame, queries: DataFrame, *columns: str) -> DataFrame:
    """A row for every bit that is set: ``q`` and the columns."""
    each = met.select("block", *columns, F.posexplode(F.array(*(f"w{i}" for i in range(WORDS)))).alias("word", "bits")).where("bits != 0")
    return each.join(queries, ["block", "word"]).where("getbit(bits, bit) = 1").select("q", *columns)


def reach_far(start: DataFrame, edges: DataFrame, depth: int, path: str, *, query: str = "query_id", node: str = "node") -> DataFrame:
    """Like :func:`reach`, for many steps: each joins only nodes that its query has not met before.

    Queries go together, ``64 * WORDS`` at a time, as bits of a node's row. Steps
    are written to ``path``, partitioned by ``hop``, in a folder that executors
    share, and what they need beside it. It ends with the first step that meets
    nothing new.
    """
    path = path.rstrip("/")
    met, queries, names = _walked(start, edges, depth, path, query, node)
    named = met.join(names, met["node"] == names["n"]).drop("node", "n").withColumnRenamed("v", "node")
    return _by_query(named, queries, "node", "hop").withColumnRenamed("q", query)


def reach_sizes(start: DataFrame, edges: DataFrame, depth: int, path: str, *, query: str = "query_id", node: str = "node", held: int = HELD) -> DataFrame:
    """``(query, hop, n_nodes, first_node, last_node)``: how many nodes :func:`reach_far` meets at each step, and the ends of their order.

    A graph that takes no more than ``held`` bytes is read by every task, which walks
    it for some of the queries, 64 at a time; nodes that are met are only counted
    and never written. A larger one is walked by joins, whose steps are written.
    """
    path, spark = path.rstrip("/"), start.sparkSession
    with settings(spark, **FREED, spark__sql__unionOutputPartitioning="false"):
        sizes, queries, names = _sizes_in_tasks(start, edges, depth, path, query, node, held)
    if sizes is None:
        met, queries, names = _walked(start, edges, depth, path, query, node)
        sizes = _by_query(met, queries, "node", "hop").groupBy("q", "hop").agg(F.count("*").alias("n_nodes"), F.min("node").alias("a"), F.max("node").alias("b"))
    else:
        sizes = sizes.join(queries, "at").drop("at")
    name = lambda n, into: names.select(F.col("n").alias(n), F.col("v").alias(into))
    return sizes.join(name("a", "first_node"), "a").join(name("b", "last_node"), "b").select(F.col("q").alias(query), "hop", "n_nodes", "first_node", "last_node")


def _gapless(values: DataFrame, path: str) -> DataFrame:
    """Like :func:`_in_order`, with numbers from 0 that leave none out."""
    rows = _in_order(values, path)
    counts = dict(rows.groupBy(F.shiftright("n", 33).alias("part")).count().collect())
    before = np.cumsum([0, *(counts.get(i, 0) for i in range(max(counts, default=0) + 1))]).tolist()
    # a monotonically increasing id is the number of a partition, and that of a row in it in the lower 33 bits
    return rows.withColumn("n", F.array(*(F.lit(x).cast("long") for x in before))[F.shiftright("n", 33).cast("int")] + F.col("n").bitwiseAND((1 << 33) - 1))


def _sizes_in_tasks(start: DataFrame, edges: DataFrame, depth: int, path: str, query: str, node: str, held: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """``(at, hop, n_nodes, a, b)``, queries and nodes by number; no sizes where the graph takes more than ``held`` bytes."""
    spark = start.sparkSession
    start, pairs = start.select(F.col(query).alias("q"), F.col(node).alias("v")).distinct(), edges.select("src", "dst").where("src is not null and dst is not null")
    names = _gapless(pairs.select(F.explode(F.array("src", "dst")).alias("v")).unionByName(start.select("v").where("v is not null")), f"{path}-names")
    n_nodes, n_pairs = names.count(), pairs.count()
    if 8 * n_pairs + 50 * n_nodes > held or n_nodes >= 1 << 32:
        return None, None, None
    queries = _gapless(start.select(F.col("q").alias("v")), f"{path}-asked").select(F.col("v").alias("q"), F.col("n").alias("at"))
    blocks = -(-queries.count() // 64)
    tasks = max(1, min(blocks, 2 * spark.sparkContext.defaultParallelism))
    of = lambda side: names.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"))
    pairs.join(of("src"), "src").join(of("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")).write.mode("overwrite").parquet(f"{path}-pairs")
    steps = both_ways(spark.read.schema("src long, dst long").parquet(f"{path}-pairs"))
    packs = "ids binary, counts binary, ends binary"
    steps.repartition("src").sortWithinPartitions("src").mapInArrow(_packed, packs).write.mode("overwrite").parquet(f"{path}-packs")
    first = start.join(queries, "q").join(names, "v").select(F.expr(f"cast((at div 64) % {tasks} as int)").alias("task"), "at", F.col("n").alias("node"))
    first.write.mode("overwrite").partitionBy("task").parquet(f"{path}-starts")
    packed = spark.read.schema(packs).parquet(f"{path}-packs")
    begun = spark.read.schema("at long, node long, task int").parquet(f"{path}-starts")
    each = []
    for task in range(tasks):  # a branch reads the graph and its own queries, so nothing is dealt
        own = begun.where(F.col("task") == task).select(*(F.lit(None).cast("binary").alias(c) for c in ("ids", "counts", "ends")), "at", "node")
        each.append(packed.select("*", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("node")).unionByName(own).coalesce(1))
    sizes = "at long, hop int, n_nodes long, a long, b long"
    reduce(DataFrame.unionByName, each).mapInArrow(_walk(n_nodes, 2 * n_pairs, depth), sizes).write.mode("overwrite").parquet(f"{path}-sizes")
    return spark.read.schema(sizes).parquet(f"{path}-sizes"), queries, names


def _packed(it):
    """Steps in the order of ``src`` as arrays of nodes, of how many steps each has, and of where these end."""

    def pack(src, dst):
        ids, counts = np.unique(src, return_counts=True)
        return pa.RecordBatch.from_pydict({"ids": [ids.astype(np.uint32).tobytes()], "counts": [counts.astype(np.int64).tobytes()], "ends": [dst.astype(np.uint32).tobytes()]})

    src, dst, size = [], [], 0
    for batch in it:
        s, d = (batch.column(i).to_numpy() for i in range(2))
        if not len(s):
            continue
        if size > PACK and src[-1][-1] != s[-1]:  # the steps of a node stay together
            cut = int(np.searchsorted(s, src[-1][-1], side="right"))
            yield pack(np.concatenate([*src, s[:cut]]), np.concatenate([*dst, d[:cut]]))
            src, dst, size, s, d = [], [], 0, s[cut:], d[cut:]
        src.append(s)
        dst.append(d)
        size += len(s)
    if size:
        yield pack(np.concatenate(src), np.concatenate(dst))


def _walk(n_nodes: int, n_steps: int, depth: int):
    """The task that holds the graph and walks it for its queries, each a bit of a node's word."""

    def walked(first: list[tuple[int, int]], degree, where, ends, packs):
        """Per step the words of nodes that are met, and which nodes these are."""
        met, word = np.zeros(n_nodes, np.uint64), np.zeros(n_nodes, np.uint64)
        for at, node in first:
            word[node] |= np.uint64(1) << np.uint64(at % 64)
        met |= word
        front = np.flatnonzero(word)
        for hop in range(1, depth + 1):
            new, of = np.zeros(n_nodes, np.uint64), degree[front]
            many = int(of.sum())
            if 8 * many < n_steps:  # from the few nodes of the last step
                steps = np.repeat(where[front] - np.cumsum(of) + of, of) + np.arange(many)
                np.bitwise_or.at(new, ends[steps], np.repeat(word[front], of))
            else:  # to every node
                for ids, lo, hi in packs:
                    new[ids] = np.bitwise_or.reduceat(word[ends[lo:hi]], where[ids] - lo)
            new &= ~met
            met |= new
            front, word = np.flatnonzero(new), new
            if not len(front):
                return
            yield hop, word[front], front

    def run(it):
        degree, where, ends = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64), np.empty(n_steps, np.uint32)
        packs, first, size = [], {}, 0
        for batch in it:
            for ids, counts, to, at, node in zip(*(batch.column(i) for i in range(5)), strict=True):
                if at.is_valid:
                    first.setdefault(at.as_py() // 64, []).append((at.as_py(), node.as_py()))
                    continue
                ids, counts, to = np.frombuffer(ids.as_buffer(), np.uint32).copy(), np.frombuffer(counts.as_buffer(), np.int64), np.frombuffer(to.as_buffer(), np.uint32)
                ends[size : size + len(to)] = to
                degree[ids], where[ids] = counts, size + np.cumsum(counts) - counts
                packs.append((ids, size, size + len(to)))
                size += len(to)
        for block, starts in first.items():
            for hop, words, nodes in walked(starts, degree, where, ends, packs):
                counts, lows, highs = _by_bit(words, nodes)
                has = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(block * 64 + has, pa.int64()), pa.array([hop] * len(has), pa.int32()), *(pa.array(x[has], pa.int64()) for x in (counts, lows, highs))], ["at", "hop", "n_nodes", "a", "b"])

    return run


def _by_bit(words: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 64 bits how many words have it, and the first and the last of these words' nodes, which are in order."""
    counts, rows = np.zeros(64, np.int64), 255  # so many ones fit in a byte
    padded = np.concatenate([words, np.zeros(-len(words) % rows, np.uint64)]).reshape(-1, rows)
    for bit in range(8):
        lanes = (padded >> np.uint64(bit) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    any_ = np.bitwise_or.reduce(padded, axis=1)
    lows, highs = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for bit in np.flatnonzero(counts).tolist():
        has = np.flatnonzero(any_ >> np.uint64(bit) & np.uint64(1))
        for out, row, end in ((lows, int(has[0]), 0), (highs, int(has[-1]), -1)):
            out[bit] = nodes[row * rows + int(np.flatnonzero(padded[row] >> np.uint64(bit) & np.uint64(1))[end])]
    return counts, lows, highs


def anchors(queries: DataFrame, nodes: DataFrame, *, query: str = "query_id", words: str = "words", text: str = "name", limit: int | None = None, saved: postings.Postings | None = None) -> DataFrame:
    """``(query, id, route)``: nodes whose text contains a word of the query, without regard to case.

    Words find their nodes by postings of n-grams; ``saved`` are those of the
    nodes' texts in lower case by id, where there is a text index.
    """
    each = queries.select(query, F.explode(words).alias("word"))
    lower = nodes.select("id", F.lower(F.col(text)).alias("_text"))
    hits = postings.containing(each, lower, phrase="word", key="id", text="_text", saved=saved).select(query, "id")
    hits = (hits if limit is None else _pruned(hits, query, limit)).distinct().withColumn("route", F.lit("concept"))
    if limit is None:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("id"))).where(F.col("_n") <= limit).drop("_n")


def _pruned(hits: DataFrame, query: str, limit: int) -> DataFrame:
    """Of ``(query, id)`` what may be among the first ``limit`` ids of a query: those of every Arrow batch, so tasks gather and sort few."""

    def run(it):
        for batch in it:
            each = pa.Table.from_batches([batch]).group_by([query, "id"]).aggregate([]).sort_by([(query, "ascending"), ("id", "ascending")])
            of = pc.fill_null(pc.dictionary_encode(each[query].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
            nth = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
            yield from each.filter(pa.array(nth < limit)).select([query, "id"]).to_batches()

    return hits.mapInArrow(run, hits.schema)


def contains_any(term: Column, *columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(c.cast("string"), term), F.lit(False))
    return out


def triples(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with the display names of their ends, in order."""
    a = nodes.select(F.col("id").alias("src"), F.coalesce("name", "id").alias("source"))
    b = nodes.select(F.col("id").alias("dst"), F.coalesce("name", "id").alias("target"))
    out = edges.join(a, "src").join(b, "dst").select("source", "type", "target").orderBy("source", "type", "target")
    return out if limit is None else out.limit(limit)


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def stored(g: Graph, path: str) -> Graph:
    """The graph as tables under ``path``, nodes by label and edges by type, so that what walks it doesn't build it at every step."""
    path, spark = path.rstrip("/"), g.nodes.sparkSession
    g.edges.select("src", "dst", "type").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    g.nodes.select("id", "name", "label").write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    nodes = spark.read.schema("id string, name string, label string").parquet(f"{path}/nodes").select("id", "label", "name")
    return Graph(nodes, spark.read.schema("src string, dst string, type string").parquet(f"{path}/edges"))


def _edges_to(rows: DataFrame, src: str, items: str, kind: str) -> DataFrame:
    each = rows.select(F.col(src).alias("src"), F.explode(items).alias("dst")).where("dst <> ''")
    return each.select("src", "dst", F.lit(kind).alias("type"))


def _ends(edges: DataFrame, label: str, side: str = "dst", name: Column | None = None) -> DataFrame:
    return edges.select(F.col(side).alias("id"), F.lit(label).alias("label"), (F.lit(None).cast("string") if name is None else name).alias("name")).distinct()


def _nodes(rows: DataFrame, key: str, label: str, name: str | None = None) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lit(label).alias("label"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))


def judgment_graph(chunks: DataFrame) -> Graph:
    """Cases, chunks, sections, concepts and cited cases of judgment chunks, every node and edge once.

    ``chunks(chunk_id, case_id, text, legal_references, legal_concepts, cited_cases)``.
    """
    has = chunks.select(F.col("case_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("type"))
    refers, discusses = _edges_to(chunks, "chunk_id", "legal_references", "REFERS_TO"), _edges_to(chunks, "chunk_id", "legal_concepts", "DISCUSSES")
    cites, mentions = _edges_to(chunks, "case_id", "cited_cases", "CITES_CASE"), _edges_to(chunks, "chunk_id", "cited_cases", "DISCUSSES_CASE")
    nodes = merge_nodes(_nodes(chunks, "case_id", "Case"), _nodes(chunks, "chunk_id", "Chunk", "text"), _ends(refers, "StatuteSection"), _ends(discusses, "LegalConcept", name=concept_name(F.col("dst"))), _ends(mentions, "CitedCase", name=F.col("dst")))
    return Graph(nodes, merge_edges(has, refers, discusses, cites, mentions))


#: Ids that a broadcast of :func:`only_of` carries at most; more are joined.
FEW = 100_000


def only_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among the few of ``wanted``, told where the rows are; where there are many, by a join."""
    few = wanted.select(key).distinct()
    return rows.join(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few, key, "left_semi")


def statute_graph(chunks: DataFrame) -> Graph:
    """Acts, sections, chunks, references, concepts and correspondences of statute chunks, every node and edge once.

    ``chunks(chunk_id, act_id, section_id, title, text, legal_references,
    legal_concepts, predecessor_references, successor_references)``.
    """
    pair = lambda a, b, kind: chunks.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    refers, discusses = _edges_to(chunks, "section_id", "legal_references", "REFERS_TO"), _edges_to(chunks, "chunk_id", "legal_concepts", "DISCUSSES")
    after, before = _edges_to(chunks, "section_id", "successor_references", "CORRESPONDS_TO"), _edges_to(chunks, "section_id", "predecessor_references", "CORRESPONDS_TO")
    before = before.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    nodes = merge_nodes(
        _nodes(chunks, "act_id", "Act"), _nodes(chunks, "section_id", "StatuteSection", "title"), _nodes(chunks, "chunk_id", "Chunk", "text"),
        _ends(refers, "StatuteSection"), _ends(after, "StatuteSection"), _ends(before, "StatuteSection", "src"), _ends(discusses, "LegalConcept", name=concept_name(F.col("dst"))),
    )
    return Graph(nodes, merge_edges(pair("act_id", "section_id", "HAS_SECTION"), pair("section_id", "chunk_id", "HAS_CHUNK"), refers, discusses, after, before))


def with_endpoints(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The nodes, and for every end of an edge that is none yet a node of that label."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id").distinct(), "id", "left_anti")
    return nodes.select("id", "label", "name").unionByName(ends.select("id", F.lit(label).alias("label"), F.lit(None).cast("string").alias("name")))


def violations(nodes: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """``(label, id, n)`` of ids that a label has more than once, or that are null; none where the graph is sound."""
    some = nodes if labels is None else nodes.where(F.col("label").isin(*labels))
    return some.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1 or id is null")


def anchor_routes(queries: DataFrame, nodes: DataFrame, *, fulltext: int = 20, cases: int = 5, query: str = "query_id", chunks: postings.Postings | None = None) -> DataFrame:
    """``(query, id, route)``: the nodes at which the graph is entered, by four routes.

    ``queries(query_id, text, words, sections)``. Explicit: sections that the
    query names. Concept: concepts whose id or name contains a word of it.
    Fulltext: chunks whose text contains all of it, the first ``fulltext``. Case:
    cases, and cited cases by name too, that contain it, the first ``cases`` of each kind.
    ``chunks`` are saved postings of the chunks' names in lower case by id.
    """
    explicit = queries.select(query, F.explode("sections").alias("id")).join(nodes.where("label = 'StatuteSection'").select("id"), "id").select(query, "id", F.lit("explicit").alias("route"))
    concepts = nodes.where("label = 'LegalConcept'").select("id", F.concat_ws("\n", "name", "id").alias("name"))
    concept = anchors(queries, concepts, query=query)
    whole = queries.select(query, F.array(F.lower(F.trim("text"))).alias("words")).where("words[0] <> ''")

    def containing(some: DataFrame, route: str, limit: int, saved: postings.Postings | None = None) -> DataFrame:
        return anchors(whole, some, query=query, limit=limit, saved=saved).select(query, "id", F.lit(route).alias("route"))

    chunk = containing(nodes.where("label = 'Chunk'"), "fulltext", fulltext, chunks)
    case = containing(nodes.where("label = 'Case'").select("id", F.col("id").alias("name")), "case", cases)
    cited = containing(nodes.where("label = 'CitedCase'").select("id", F.concat_ws("\n", "id", "name").alias("name")), "case", cases)
    return explicit.unionByName(concept).unionByName(chunk).unionByName(case).unionByName(cited).distinct()


def traverse(start: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, *, query: str = "query_id", node: str = "node") -> DataFrame:
    """Per query three sorted sets of ids around its nodes: ``statutes``, ``judgments`` (chunks) and ``cited_cases``.

    From a section: sections within ``depth`` steps of correspondence, reference
    or discussion, and chunks within ``depth`` references. From a concept: the
    chunks that discuss it; from a case: its chunks; a chunk stands for itself.
    Sections are also those that such chunks (but a section's own) refer to, and
    cited cases those of the cases of all chunks, and of the case itself. Each
    set has its own frontier, so nothing is multiplied.
    """
    rows = _around(start, nodes, edges, depth, query, node)
    rows = start.select(query, F.lit(None).cast(nodes.schema["id"].dataType).alias("node"), F.lit("").alias("k")).unionByName(rows)
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("node"))))
    return rows.groupBy(query).agg(pick("s").alias("statutes"), pick("j").alias("judgments"), pick("c").alias("cited_cases"))


def _around(start: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, query: str, node: str, keep: Keep | None = None, last: Callable | None = None) -> DataFrame:
    """``(query, node, k)`` of the sets of :func:`traverse`; ``last`` takes the step from cases to what they cite."""
    keep = keep or (lambda rows: rows)
    label = nodes.select(F.col("id").alias("node"), "label")
    at = start.select(query, F.col(node).alias("node")).distinct().join(label, "node")
    of = lambda *kinds: at.where(F.col("label").isin(*kinds)).select(query, "node")
    kind = lambda *types: edges.where(F.col("type").isin(*types)).select("src", "dst", "type")
    ids = lambda *labels: nodes.where(F.col("label").isin(*labels)).select(F.col("id").alias("node"))
    hop = lambda rows, e: rows.select(query, F.col("node").alias("src")).join(e, "src").select(query, F.col("dst").alias("node")).distinct()
    last = last or hop
    both = lambda *types: both_ways(kind(*types))
    back = lambda *types: kind(*types).select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    sections = of("StatuteSection")
    near = reach(sections, kind("CORRESPONDS_TO", "REFERS_TO", "DISCUSSES"), depth, query=query, into=ids("StatuteSection"), keep=keep).select(query, "node")
    read = reach(sections, kind("REFERS_TO"), depth, query=query, into=ids("Chunk"), keep=keep).select(query, "node")
    own = of("Chunk").unionByName(hop(of("LegalConcept"), back("DISCUSSES")).join(ids("Chunk"), "node").select(query, "node")).unionByName(hop(of("Case", "CitedCase"), kind("HAS_CHUNK")).join(ids("Chunk"), "node").select(query, "node")).distinct()
    told = hop(own, kind("REFERS_TO")).join(ids("StatuteSection"), "node")
    chunks = keep(read.select(query, "node").unionByName(own).distinct())
    cases = hop(chunks, back("HAS_CHUNK")).join(ids("Case"), "node").select(query, "node").unionByName(of("Case", "CitedCase")).distinct()
    cited = last(cases, both("CITES_CASE")).join(ids("CitedCase"), "node")
    return near.select(query, "node", F.lit("s").alias("k")).unionByName(told.select(query, "node", F.lit("s").alias("k"))).unionByName(chunks.select(query, "node", F.lit("j").alias("k"))).unionByName(cited.select(query, "node", F.lit("c").alias("k")))


def traverse_far(start: DataFrame, g: Graph, path: str, depth: int = 3, *, query: str = "query_id", node: str = "node") -> DataFrame:
    """Like :func:`traverse`, for many nodes in a large graph: ``path`` holds the graph in numbers and every step.

    The step from cases to what they cite, where queries meet the same nodes most,
    goes for ``64 * WORDS`` queries together, a bit for each.
    """
    path, spark, made = path.rstrip("/"), g.nodes.sparkSession, []

    def keep(rows: DataFrame) -> DataFrame:
        made.append(f"{path}/{len(made)}")
        rows.write.mode("overwrite").parquet(made[-1])
        return spark.read.schema(rows.schema).parquet(made[-1])

    with settings(spark, **FREED):
        names = _gapless(g.nodes.select(F.col("id").alias("v")), f"{path}/names")
        of = lambda side: names.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"))
        labels = keep(g.nodes.join(of("id"), "id").select(F.col("n_id").alias("id"), "label"))
        some = g.edges.where(F.col("type").isin("CORRESPONDS_TO", "REFERS_TO", "DISCUSSES", "HAS_CHUNK", "CITES_CASE"))
        steps = some.join(of("src"), "src").join(of("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "type")
        steps.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
        steps = spark.read.schema("src long, dst long, type string").parquet(f"{path}/edges")
        asked = _gapless(start.select(F.col(query).alias("v")), f"{path}/queries").select(F.col("v").alias(query), F.col("n").alias("at"))
        first = keep(start.select(query, F.col(node).alias("v")).join(asked, query).join(names, "v").select("at", F.col("n").alias("node")))
        rows = keep(_around(first, labels, steps, depth, "at", "node", keep, lambda rows, e: _in_blocks(keep(rows), e)))
        named = rows.join(names, rows["node"] == names["n"]).select("at", "k", F.col("v").alias("node"))
        sets = named.groupBy("at", "k").agg(F.array_sort(F.collect_set("node")).alias("nodes")).groupBy("at")
        none = F.array().cast("array<string>")
        sets = sets.agg(*(F.coalesce(F.first(F.when(F.col("k") == k, F.col("nodes")), ignorenulls=True), none).alias(to) for k, to in (("s", "statutes"), ("j", "judgments"), ("c", "cited_cases"))))
    return asked.join(sets, "at", "left").select(query, *(F.coalesce(c, none).alias(c) for c in ("statutes", "judgments", "cited_cases")))


def _in_blocks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``(at, node)`` one step from ``rows(at, node)``, each once; queries of a block go together as bits."""
    words = [f"w{i}" for i in range(WORDS)]
    held = rows.groupBy(F.expr(f"shiftright(at, 6) div {WORDS}").alias("block"), F.col("node").alias("src"))
    held = held.agg(*(F.expr(f"bit_or(if(shiftright(at, 6) % {WORDS} = {i}, shiftleft(1L, cast(at % 64 as int)), 0L))").alias(w) for i, w in enumerate(words)))
    moved = held.join(edges.select("src", "dst"), "src").groupBy("block", F.col("dst").alias("node")).agg(*(F.expr(f"bit_or({w})").alias(w) for w in words))
    each = moved.select("block", "node", F.posexplode(F.array(*words)).alias("word", "bits")).where("bits != 0").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return each.where("getbit(bits, bit) = 1").select(F.expr(f"(block * {WORDS} + word) * 64 + bit").alias("at"), "node")


def chain_counts(start: DataFrame, key: str, *links: tuple[DataFrame, str, dict[str, str]]) -> DataFrame:
    """Distinct targets along a chain of optional edges, per start row.

    Every link is ``(table, column, targets)``: the table is joined on the column
    that the step before has as well, ``targets`` are result names and columns
    to count. Each target has a frontier of its own without repeats, so several
    targets don't multiply.
    """
    out, front = start.select(key).distinct(), start.select(key).distinct()
    for rows, on, targets in links:
        front = front.join(rows, on, "left") if on in front.columns else front
        for name, column in targets.items():
            n = front.where(F.col(column).isNotNull()).select(key, column).distinct().groupBy(key).agg(F.count("*").alias(name))
            out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
        front = front.distinct()
    return out


def linked_context(parents: DataFrame, key: str, children: DataFrame, on: str, item: str, limit: int) -> DataFrame:
    """Per parent how many children it has, and the first ``limit`` of them joined by commas; 0 and empty for none.

    Only the first are gathered, so a parent of any size fits in a task.
    """
    each = children.select(F.col(on).alias(key), item).where(F.col(item).isNotNull())
    counts = each.groupBy(key).agg(F.count("*").alias("n"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(F.col("_n") <= limit)
    shown = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)).cast("array<string>"), ",").alias("items"))
    out = parents.join(counts, key, "left").join(shown, key, "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "items": F.coalesce("items", F.lit(""))})
