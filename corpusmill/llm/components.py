"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fingerprint, forget, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the smallest node reachable.

    Each round hangs every node under the smallest neighbour known, so a path
    shortens geometrically. Minima are aggregated before the shuffle, and the
    joins are plain equi-joins that adaptive execution splits on hot nodes.
    Self-loops and null ends are ignored; no edges give an empty table.
    """
    e = materialize(_clean(edges, a, b), "edges")
    seen = fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(before, large)
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _clean(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
