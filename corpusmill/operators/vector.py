"""Exact vector search over embedding columns."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the corpus carries along; more take several passes.
QUERY_BLOCK = 4096
#: Scores that a matrix product makes at once.
CELLS = 1_000_000
#: Pairs that a task gives at once.
ROWS_OUT = 8192


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where either side or a component is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """Unit vector; vectors shorter than 1e-12 keep their components."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-12, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(score: Column) -> Column:
    """Cosine distance to six places."""
    return F.round(1 - score, 6)


def with_norm(df: DataFrame, vec: str = "embedding", into: str = "norm") -> DataFrame:
    """Index-time norms, so that scoring a pair is one inner product."""
    return df.withColumn(into, norm(F.col(vec)))


def rank_by_score(hits: DataFrame, query: str, score: str, key: str, into: str = "vector_rank") -> DataFrame:
    """1-based rank of each query's hits; the key breaks ties."""
    return hits.withColumn(into, F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, query: str = "query_id", query_vec: str = "query_vec", key: str = "vec_id", vec: str = "embedding", keep: Iterable[str] = (), queries_keep: Iterable[str] = (), block: int = QUERY_BLOCK, bulk: bool = False) -> DataFrame:
    """The ``max(k, 1)`` nearest corpus rows of every query, by cosine, ranked.

    The queries are the small side: they are counted, and dealt to as many
    passes as it takes for a pass to carry ``block`` of them. Each task keeps the
    best of its own rows per query (a limit pushed below the shuffle), so what is
    moved grows with queries and tasks and not with the corpus.

    ``bulk`` is for large corpora: matrix products over Arrow batches first let
    go of all but each task's best, and only those are scored by expressions.
    The result is the same.
    """
    q = with_norm(queries.select(query, *queries_keep, query_vec), query_vec, "_qn").where("_qn > 0")
    c = with_norm(corpus.select(key, *keep, vec), vec, "_cn").where("_cn > 0")
    passes = max(1, -(-q.count() // block))
    parts = []
    for p in range(passes):
        part = q if passes == 1 else q.where(F.pmod(F.xxhash64(query), F.lit(passes)) == p)
        joined = _bulk_candidates(c, part, max(k, 1), query, query_vec, key, vec) if bulk else c.crossJoin(F.broadcast(part))
        pairs = joined.withColumn("score", dot(F.col(query_vec), F.col(vec)) / (F.col("_qn") * F.col("_cn")))
        parts.append(rank_by_score(pairs.select(query, *queries_keep, key, *keep, "score"), query, "score", key).where(F.col("vector_rank") <= max(k, 1)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _bulk_candidates(corpus: DataFrame, queries: DataFrame, k: int, query: str, query_vec: str, key: str, vec: str) -> DataFrame:
    """Pairs of which one task's best ``k`` per query are surely some, with the columns of both sides."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.collect()  # one block of queries at most
    held = corpus.sparkSession.sparkContext.broadcast((np.array([r[query_vec] for r in asked], dtype=np.float64), np.array([r["_qn"] for r in asked]), [r[query] for r in asked]))
    key_type = queries.schema[query].dataType.simpleString()
    key_arrow = to_arrow_type(queries.schema[query].dataType)

    def run(it):
        q, qn, ids = held.value
        rows: list[pa.RecordBatch] = []  # rows that some query wants, each once
        i, j, s = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)  # pairs of a query and one of these rows
        held_rows, most = 0, 2 * k * len(ids) + 50_000
        best = np.full((len(ids), k), -np.inf)
        least = best.min(axis=1)  # the k-th best score so far, per query
        step = max(1, CELLS // max(1, len(ids)))
        few = (b.take(pa.array(fewer_copies(b))) for b in it if len(ids) and b.num_rows)
        for batch in (b.slice(lo, step) for b in few for lo in range(0, b.num_rows, step)):
            v = np.asarray(batch.column(vec).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            score = (q @ v.T) / (qn[:, None] * np.asarray(batch.column("_cn"))[None, :])
            a, b = np.nonzero(score >= least[:, None] - 1e-9)
            if not len(a):
                continue
            some = np.unique(a)
            best[some] = -np.partition(-np.hstack([best[some], score[some]]), k - 1, axis=1)[:, :k]
            least[some] = best[some].min(axis=1)
            good = score[a, b] >= least[a] - 1e-9
            a, b = a[good], b[good]
            taken, at = np.unique(b, return_inverse=True)
            rows.append(batch.take(pa.array(taken)))
            i, j, s = np.append(i, a.astype(np.int32)), np.append(j, (at + held_rows).astype(np.int32)), np.append(s, score[a, b])
            held_rows += len(taken)
            if len(i) > most:
                rows, i, j, s = narrowed(rows, i, j, s, least)
                held_rows, most = rows[0].num_rows, max(most, 2 * len(i))
        if len(i):
            rows, i, j, s = narrowed(rows, i, j, s, least)
            for lo in range(0, len(i), ROWS_OUT):
                out = rows[0].take(pa.array(j[lo : lo + ROWS_OUT]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([ids[x] for x in i[lo : lo + ROWS_OUT]], key_arrow)], [*out.schema.names, query])

    def fewer_copies(batch) -> np.ndarray:
        """Equal vectors score alike, so only the ``k`` smallest keys of each can be among the best: the places of these."""
        v = np.ascontiguousarray(np.asarray(batch.column(vec).flatten()).reshape(batch.num_rows, -1))
        _, same = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        if same.max() + 1 == batch.num_rows:
            return np.arange(batch.num_rows)
        order = pc.sort_indices(pa.table({"v": same, "k": batch.column(key)}), [("v", "ascending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        run_of = same[order]
        nth = np.arange(len(order)) - np.searchsorted(run_of, run_of, side="left")
        return np.sort(order[nth < k])

    def narrowed(rows, i, j, s, least):
        """Pairs that still reach their query's k-th best, and their rows in one batch."""
        good = s >= least[i] - 1e-9
        i, j, s = i[good], j[good], s[good]
        used, j = np.unique(j, return_inverse=True)
        own = pa.Table.from_batches(rows).take(pa.array(used)).combine_chunks().to_batches()[0]
        kept = fewer_copies(own)
        place = np.full(own.num_rows, -1)
        place[kept] = np.arange(len(kept))
        good = place[j] >= 0
        return [own.take(pa.array(kept))], i[good], place[j[good]].astype(np.int32), s[good]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema.fields] + [f"`{query}` {key_type}"])
    some = corpus.where(~F.exists(vec, lambda x: x.isNull()) & (F.size(vec) == (len(asked[0][query_vec]) if asked else 0)))
    return some.mapInArrow(run, schema).join(F.broadcast(queries), query)


def hashed_bag_of_words(text: Column, dim: int = 64) -> Column:
    """Offline stand-in for a text encoder: counts of word hashes, not normalised; nothing but zeros for null.

    Words are hashed by expressions and counted in Arrow batches, each once.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    @F.arrow_udf("array<float>")
    def counted(buckets: pa.Array) -> pa.Array:
        n, at = len(buckets), buckets.value_lengths().to_numpy(zero_copy_only=False)
        flat = buckets.flatten().to_numpy(zero_copy_only=False) + dim * np.repeat(np.arange(n), at)
        counts = np.bincount(flat.astype(np.int64), minlength=n * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(counts))

    return counted(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")))
