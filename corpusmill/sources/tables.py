"""Tables that are kept at a path: rows by key in hashed buckets, of which a merge rewrites those that it touches.

A bucket is a partition, so the rows of other buckets are neither read nor
written, and their files stay as they are. What replaces the touched buckets is
staged by Spark's dynamic partition overwrite: a merge that fails or is killed
while it computes leaves the table as it was, and running it again gives what one
run would have given. (Partitions are swapped one by one when the job commits.)
The number of buckets is part of the partition's name, so every reader and writer
of a table has the same; take as many as keep a bucket near a gigabyte.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import accepted, last_of_each

BUCKET = "bucket_of_"


class Merged(NamedTuple):
    """Rows that a merge brought, and the buckets that it rewrote of all there are."""

    rows: int
    rewritten: int
    buckets: int


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with its bucket column, None where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if not any(c.startswith(BUCKET) for c in df.columns):
        raise ValueError(f"{path} is no table of buckets")
    return df


def bucket_column(df: DataFrame) -> str:
    return next(c for c in df.columns if c.startswith(BUCKET))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table at ``path``."""
    df = spark.read.parquet(path)
    return df.drop(bucket_column(df))


def merge_table(path: str, rows: DataFrame, keys: DataFrame, key: str, buckets: int = 64) -> Merged:
    """Put ``rows`` in place of all rows whose ``key`` is among ``keys``.

    Keys that have no rows lose those they had. Both inputs are read more than
    once, so they must be repeatable (tables, not samples). Null keys are left
    out. A new table takes ``buckets``, one that exists keeps its own number and
    columns: what ``rows`` lacks of them is null, what they have beyond is dropped.
    No keys leave the table as it is; a table that isn't there is made even so.
    """
    spark = rows.sparkSession
    held = stored(spark, path)
    name = bucket_column(held) if held is not None else f"{BUCKET}{buckets}"
    count = int(name.removeprefix(BUCKET))
    of = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(count)).cast("int")
    keys, rows = (df.where(F.col(key).isNotNull()).withColumn(name, of) for df in (keys.select(key).distinct(), rows))
    if held is None:
        new, touched = rows, None
    else:
        touched = sorted(r[0] for r in keys.select(name).distinct().collect())  # as many as there are buckets at most
        kept = held.where(F.col(name).isin(touched)).join(keys.select(key), key, "left_anti")
        columns = {f.name: f.dataType for f in held.schema.fields}
        own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        new = kept.select(*columns).unionByName(rows.select(*own))
    brought = rows.join(keys.select(key), key, "left_semi").groupBy(name).count().collect()
    emptied = set(touched or ()) - {r[0] for r in brought}
    if emptied:
        emptied -= {r[0] for r in kept.where(F.col(name).isin(*emptied)).select(name).distinct().collect()}
    if touched is None or touched:
        out = new if touched is None else new.join(F.broadcast(spark.createDataFrame([(b,) for b in touched], f"{name} int")), name, "left_semi")
        out.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    for b in sorted(emptied):  # a dynamic overwrite leaves partitions without new rows alone
        new.drop(name).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}={b}")
    return Merged(sum(r["count"] for r in brought), count if touched is None else len(touched), count)


def upsert_table(path: str, source: DataFrame, key: str, *, order: str | None = None, text: str | None = None, buckets: int = 64) -> Merged:
    """Merge ``source`` into the table by ``key``: the last row of each key counts, blank texts are refused."""
    new = last_of_each(accepted(source, key, text), key, order)
    return merge_table(path, new, new, key, buckets)


def insert_into_table(path: str, source: DataFrame, key: str, *, order: str | None = None, text: str | None = None, buckets: int = 64) -> Merged:
    """Like an upsert, but keys that the table has keep their rows."""
    held = stored(source.sparkSession, path)
    if held is not None:
        name = bucket_column(held)
        of = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(int(name.removeprefix(BUCKET)))).cast("int")
        source = source.withColumn(name, of).join(held.select(name, key), [name, key], "left_anti").drop(name)
    return upsert_table(path, source, key, order=order, text=text, buckets=buckets)


def replace_in_table(path: str, rows: DataFrame, documents: DataFrame, document: str, buckets: int = 64) -> Merged:
    """All rows of the ``documents`` replaced, so that no old tail of one stays; those without rows lose theirs."""
    return merge_table(path, rows, documents, document, buckets)


def delete_from_table(path: str, ids: DataFrame, key: str) -> Merged:
    """The table without the rows of some keys; ids that it doesn't have change nothing."""
    held = stored(ids.sparkSession, path)
    if held is None:
        raise FileNotFoundError(path)
    return merge_table(path, held.drop(bucket_column(held)).limit(0), ids.join(held.select(key).distinct(), key, "left_semi"), key)
