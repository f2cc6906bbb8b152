"""Vector search by inverted lists: a corpus dealt to lists around centroids, of which a query reads few.

Centroids are fitted on a bounded sample of rows, the first ``SAMPLE`` by a hash of
their key; every row is in one list. Lists are partitions of a Parquet table, so a
search reads only the files of lists that some query asks. Two searches:

* :func:`search` with a number of ``probes`` reads the nearest lists of each query.
  :func:`calibrated` widens that number until an audit against exact search finds
  the recall that is asked for.
* :func:`search` with ``exact`` reads on where a list could still hold something:
  a list's radius bounds the cosine of all its rows, so lists that can't reach the
  ``k``-th best found so far are left out, and the result is that of exact search.

Scores of pairs are made by matrix products over blocks of one list and some
queries; what these leave is scored again by expressions, as exact search does.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from . import vector

#: Rows that centroids are fitted on at most, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, LISTS = 16_384, 12, 4096
#: Rows and queries of a list that one block of scores holds at most, about.
ROWS_OF_BLOCK, QUERIES_OF_BLOCK = 8192, 2048
#: Queries of an audit.
AUDIT = 256
#: What rounding may do to a cosine or an angle.
SLACK = 1e-6


class Index(NamedTuple):
    """Lists at a path; one row for each in ``centroids``: of at most ``LISTS``, so they fit anywhere."""

    path: str
    key: str
    vec: str
    lists: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    #: Columns of the rows; of an empty index that was opened, none but key and vector are known.
    schema: StructType


def valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has a length that can be divided by."""
    n = vector.norm(F.col(vec))
    return df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & (n > 0) & (n < float("inf")))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors: the farthest rows one after the other, then some rounds of means."""
    x = _unit(sample)
    best = x @ x[0]
    chosen = [0]
    while len(chosen) < min(lists, len(x)):
        at = int(best.argmin())
        if best[at] > 1 - 1e-12:
            break  # all others are copies
        chosen.append(at)
        best = np.maximum(best, x @ x[at])
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), c)
    return c


def build(corpus: DataFrame, path: str, *, key: str = "vec_id", vec: str = "embedding", lists: int | None = None) -> Index:
    """Write an index of ``corpus`` at ``path``, with all its columns, and open it.

    Rows whose vector is null, zero or not finite are in no list, as no search
    finds them. ``lists`` is about the root of the number of rows by default.
    """
    import pyarrow as pa

    spark, rows = corpus.sparkSession, valid(corpus, vec)
    path = path.rstrip("/")
    some = rows.select(vec, F.xxhash64(F.col(key).cast("string")).alias("_h"), key).orderBy("_h", key).limit(SAMPLE).select(vec).toPandas()
    sample = np.array(some[vec].tolist(), dtype=np.float64).reshape(len(some), -1 if len(some) else 0)
    wanted = lists or max(1, min(LISTS, int(rows.count() ** 0.5)))
    held = spark.sparkContext.broadcast(fitted(sample, min(wanted, LISTS)) if len(sample) else np.zeros((0, 0)))
    names = rows.columns
    at = names.index(vec)

    def dealt(it):
        c = held.value
        for batch in it:
            if batch.num_rows:
                score = _unit(_matrix(batch.column(at))) @ c.T
                of = score.argmax(axis=1)
                angle = np.arccos(np.clip(score[np.arange(len(of)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(angle)], [*names, "list", "_angle"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "list int", "_angle double"])
    out = rows.mapInArrow(dealt, schema)
    out.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    sizes = spark.read.schema(out.schema).parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n"), F.max("_angle").alias("radius")).collect()  # a row for each list
    found = [(r["list"], held.value[r["list"]].tolist(), r.n, r.radius) for r in sorted(sizes)]
    spark.createDataFrame(found, "list int, centroid array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return opened(spark, path, key=key, vec=vec)._replace(schema=out.schema)


def opened(spark: SparkSession, path: str, *, key: str = "vec_id", vec: str = "embedding") -> Index:
    """The index that was written at ``path``."""
    rows = sorted(spark.read.schema("list int, centroid array<double>, n long, radius double").parquet(f"{path}/centroids").collect())  # as many as lists
    columns = [(key, LongType()), (vec, ArrayType(DoubleType())), ("list", IntegerType()), ("_angle", DoubleType())]
    schema = spark.read.parquet(f"{path}/rows").schema if rows else StructType([StructField(*c) for c in columns])
    return Index(path, key, vec, np.array([r["list"] for r in rows], np.int32), np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1 if rows else 0), np.array([r.n for r in rows], np.int64), np.array([r.radius for r in rows], np.float64), schema)


def _packed(index: Index) -> np.ndarray:
    """For every list the number of its block: lists in order, up to ``ROWS_OF_BLOCK`` rows together."""
    out, block, held = [], -1, 0
    for n in index.sizes.tolist():
        if block < 0 or held + n > ROWS_OF_BLOCK:
            block, held = block + 1, 0
        out.append(block)
        held += n
    return np.array(out, np.int32)


def _asked(queries: DataFrame, index: Index, vec: str, name: str, probes: int, floor: str | None = None) -> DataFrame:
    """``(query, list)`` of the nearest lists; with a column ``floor`` of all blocks of lists of which one can reach it."""
    import pyarrow as pa

    spark = queries.sparkSession
    held = spark.sparkContext.broadcast((index.lists, index.centroids, index.radii, _packed(index)))
    some = queries.select(name, vec, *([floor] if floor else []))
    kind = some.schema[name].dataType.simpleString()

    def run(it):
        ids, c, radii, blocks = held.value
        for batch in it:
            if not batch.num_rows or not len(ids):
                continue
            score = _unit(_matrix(batch.column(1))) @ c.T
            if floor:
                reach = np.cos(np.minimum(np.pi, np.maximum(0, np.arccos(np.clip(score, -1, 1)) - radii[None, :] - SLACK)))
                least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                i, j = np.nonzero(reach >= least[:, None] - SLACK)
                i, j = np.unique(np.stack([i, blocks[j]]), axis=1)
                to = j.astype(np.int32)
            else:
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                i, to = np.repeat(np.arange(len(near)), near.shape[1]), ids[near.ravel()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(to)], [name, "list"])

    return some.mapInArrow(run, f"`{name}` {kind}, list int")


def _scanned(asked: DataFrame, queries: DataFrame, index: Index, k: int, name: str, vec: str, keep: list[str], floor: str | None = None, scores: bool = False) -> DataFrame:
    """Pairs of each query and rows of its lists among which the best ``k`` of every list are, with ``_about``, their score but for rounding.

    A list and its queries are dealt to blocks of a bounded size, however large
    or sought after the list is. With a column ``floor`` what is asked are blocks
    of lists (:func:`_packed`), and pairs below the query's floor are left out.
    With ``scores`` pairs have no columns of the rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = queries.sparkSession
    counts = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list at most
    of = _packed(index) if floor else index.lists
    parts = [(x, b, -(-n // ROWS_OF_BLOCK), -(-counts[b] // QUERIES_OF_BLOCK)) for x, b, n in zip(index.lists.tolist(), of.tolist(), index.sizes.tolist(), strict=True) if b in counts]
    rows = spark.read.schema(index.schema).parquet(f"{index.path}/rows").where(F.col("list").isin(*(x[0] for x in parts)) if parts else F.lit(False))
    blocks = F.broadcast(spark.createDataFrame(parts, "list int, _block int, rows_in int, queries_in int"))
    of_block = F.broadcast(spark.createDataFrame(sorted({x[1]: x[1:] for x in parts}.values()), "list int, rows_in int, queries_in int"))
    deal = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_columns = [index.key, index.vec, *keep]
    left = rows.withColumn("_in", F.col("list")).join(blocks, "list").select("_block", *own_columns, "rows_in", "queries_in").withColumn("r", deal(index.key, "rows_in")).withColumn("q", every("queries_in")).drop("rows_in", "queries_in")
    bound = [F.col(floor).alias("_floor")] if floor else []
    right = asked.join(queries.select(name, vec, *([floor] if floor else [])), name).join(of_block, "list").withColumn("q", deal(name, "queries_in")).withColumn("r", every("rows_in")).select(F.col("list").alias("_list"), F.col("r").alias("_r"), F.col("q").alias("_q"), F.col(name).alias("_query"), F.col(vec).alias("_query_vec"), *bound)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    told = [] if scores else own_columns
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in told), f"`{name}` {queries.schema[name].dataType.simpleString()}", "_about double"])

    def best(own, asking):
        own = own.select(own_columns).combine_chunks()
        few = _fewer_copies(own, index.key, index.vec, k)
        v, q = _unit(_matrix(few[index.vec].combine_chunks())), _unit(_matrix(asking["_query_vec"].combine_chunks()))
        floors = np.array([-np.inf if x is None else x for x in asking["_floor"].to_pylist()]) if floor else np.full(len(q), -np.inf)
        i, j, found = [], [], []
        for low in range(0, len(q), 256):
            score = q[low : low + 256] @ v.T
            least = floors[low : low + 256]
            many = np.nonzero((score >= least[:, None] - 1e-9).sum(axis=1) > k)[0]
            if len(many):
                least[many] = np.maximum(least[many], -np.partition(-score[many], k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero(score >= least[:, None] - 1e-9)
            i.append(a + low)
            j.append(b)
            found.append(score[a, b])
        out = few.select(told).take(pa.array(np.concatenate(j)))
        pairs = {name: pc.take(asking["_query"], pa.array(np.concatenate(i))), "_about": pa.array(np.concatenate(found))}
        return pa.table({**{c: out[c] for c in told}, **pairs})

    def none(own, asking):
        return pa.table({**{c: own[c].slice(0, 0) for c in told}, name: asking["_query"].slice(0, 0), "_about": pa.array([], pa.float64())})

    return left.groupBy("_block", "r", "q").cogroup(right.groupBy("_list", "_r", "_q")).applyInArrow(lambda own, asking: (best if own.num_rows and asking.num_rows else none)(own, asking), schema)


def _fewer_copies(rows, key: str, vec: str, k: int):
    """Equal vectors score alike, so only the ``k`` smallest keys of each can be among the best."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = rows[vec].combine_chunks()
    v = np.ascontiguousarray(np.asarray(column.flatten()).reshape(len(column), -1))
    _, same = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    if same.max() + 1 == len(rows):
        return rows
    order = pc.sort_indices(pa.table({"v": same, "k": rows[key]}), [("v", "ascending"), ("k", "ascending")], null_placement="at_start").to_numpy()
    run_of = same[order]
    nth = np.arange(len(order)) - np.searchsorted(run_of, run_of, side="left")
    return rows.take(pa.array(np.sort(order[nth < k])))


def _ranked(pairs: DataFrame, queries: DataFrame, index: Index, k: int, name: str, vec: str) -> DataFrame:
    """The ``k`` best pairs of each query, of those that rounding leaves open scored by expressions."""
    own, about = Window.partitionBy(name), Window.partitionBy(name).orderBy(F.desc("_about"))
    best = pairs.withColumn("_n", F.row_number().over(about)).withColumn("_least", F.min(F.when(F.col("_n") <= k, F.col("_about"))).over(own)).where(F.col("_about") >= F.col("_least") - 1e-9)
    q = queries.select(name, vec)
    score = vector.dot(F.col(vec), F.col(index.vec)) / (vector.norm(F.col(vec)) * vector.norm(F.col(index.vec)))
    scored = best.drop("_n", "_least", "_about").join(q, name).withColumn("score", score).drop(vec, index.vec)
    return vector.rank_by_score(scored, name, "score", index.key).where(F.col("vector_rank") <= k)


def search(queries: DataFrame, index: Index, k: int, *, probes: int = 8, exact: bool = False, query: str = "query_id", query_vec: str = "query_vec", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``max(k, 1)`` best rows of the lists that each query reads, ranked: ``query, key, *keep, score, vector_rank``.

    With ``exact``, of all rows: the ``k``-th best of the root of the number of lists, and of
    ``probes`` at most, is a floor below which no row is told. Queries without a valid vector find nothing.
    """
    k = max(k, 1)
    q = valid(queries.select(query, query_vec), query_vec)
    few = min(probes, int(len(index.lists) ** 0.5) + 1) if exact else probes
    asked = _asked(q, index, query_vec, query, few)
    if not exact:
        return _ranked(_scanned(asked, q, index, k, query, query_vec, list(keep)), q, index, k, query, query_vec)
    first = _scanned(asked, q, index, k, query, query_vec, [], scores=True).groupBy(query).agg(F.sort_array(F.collect_list("_about"), False).alias("_best"))
    floored = q.join(first.select(query, F.get("_best", F.lit(k - 1)).alias("_floor")), query, "left")
    more = _asked(floored, index, query_vec, query, 0, "_floor")
    return _ranked(_scanned(more, floored, index, k, query, query_vec, list(keep), "_floor"), q, index, k, query, query_vec)


def recall(found: DataFrame, truth: DataFrame, query: str, key: str) -> float:
    """Which part of the true pairs was found; 1 where there are none."""
    both = truth.select(query, key).join(found.select(query, key).withColumn("_hit", F.lit(1)), [query, key], "left")
    n, hits = both.agg(F.count("*"), F.coalesce(F.sum("_hit"), F.lit(0))).first()
    return hits / n if n else 1.0


def calibrated(queries: DataFrame, index: Index, k: int, *, least: float = 0.95, query: str = "query_id", query_vec: str = "query_vec") -> tuple[int, float]:
    """The probes, doubled until the audit's recall is ``least``, and that recall.

    The audit asks the first ``AUDIT`` queries by hash of their id; the truth is
    the exact search of all rows, made once: a search finds those true rows whose
    lists it reads. At all lists the recall is 1.
    """
    q = valid(queries.select(query, query_vec), query_vec)
    asked = q.orderBy(F.xxhash64(F.col(query).cast("string")), query).limit(AUDIT)
    truth = search(asked, index, k, probes=len(index.lists), exact=True, query=query, query_vec=query_vec, keep=("_in",)).select(query, "_in").collect()  # k rows for each of few queries
    nth = {}
    for r in asked.collect() if truth else ():
        near = np.argsort(-(_unit(np.array([r[query_vec]], np.float64)) @ index.centroids.T)[0], kind="stable")
        nth[r[query]] = {x: i for i, x in enumerate(index.lists[near].tolist())}
    at = np.array([nth[r[query]][r["_in"]] for r in truth])
    probes = 1
    while True:
        got = 1.0 if probes >= len(index.lists) or not len(at) else float((at < probes).mean())
        if got >= least:
            return min(probes, len(index.lists)), got
        probes *= 2
