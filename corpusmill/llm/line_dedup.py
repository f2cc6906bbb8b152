"""Removal of repeated line runs by distributed prefix doubling (DataFrame functions only).

The lines of all documents form one long sequence of line ids. Round ``k`` of
prefix doubling names what stands in the ``2**k`` lines from a position on, out
of two names of the round before; positions with equal names form an interval
of the suffix array whose common prefix has at least that length. Positions
that stand alone in their interval leave, so the rounds shrink fast. A run of
any length is then known by the names of its first and its last ``2**k`` lines.

A run of consecutive lines of one document counts as repeated when the same
lines stand at an earlier position (in the order of ``doc_id``, then line
number) and it has ``min_words`` words or more. All lines of such a run go, so
what stays of equal passages is the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, integral_ids, materialize, quoted

AT = ["d", "th", "i"]
_WORDS = r"size(filter(split(line, '[ \\t\\x0B\\f\\r]+'), x -> x <> ''))"


def _keys(docs: DataFrame, text: str) -> DataFrame:
    """A document is known by its ``doc_id`` (null as the smallest) and the hash of its text."""
    return docs.withColumn("d", F.expr("coalesce(cast(doc_id as long), -9223372036854775808L)")).withColumn("th", F.xxhash64(text))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    each = _keys(docs.select("doc_id", F.col(text).alias("text")), "text").select("d", "th", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return each.select("d", "th", "i", F.xxhash64("line").alias("n1"), F.xxhash64(F.lit(11), "line").alias("n2"), F.expr(_WORDS).cast("long").alias("w"))


def _shared(named: DataFrame) -> DataFrame:
    """Only the positions whose name another position has as well."""
    often = named.groupBy("n1", "n2").agg(F.count("*").alias("n")).where("n > 1").select("n1", "n2")
    return named.join(often, ["n1", "n2"], "left_semi")


def _windows(runs: DataFrame, min_words: int) -> DataFrame:
    """``(d, th, i, m)``: the shortest runs of ``min_words`` words that begin, and that end, at each line.

    Together they cover every line of every longer run, and nothing else.
    """
    island = Window.partitionBy("d", "th").orderBy("i")
    r = runs.withColumn("isle", F.col("i") - F.row_number().over(island))
    whole = Window.partitionBy("d", "th", "isle")
    r = r.withColumn("all", F.sum("w").over(whole)).where(F.col("all") >= min_words)
    r = r.withColumn("end", F.sum("w").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("w"))
    ahead = whole.orderBy("begin").rangeBetween(0, min_words - 1)
    back = whole.orderBy("end").rangeBetween(-(min_words - 1), 0)
    first = r.withColumn("j", F.max("i").over(ahead)).withColumn("reach", F.max("end").over(ahead)).where(F.col("reach") >= F.col("begin") + min_words)
    last = r.withColumn("j", F.min("i").over(back)).withColumn("reach", F.min("begin").over(back)).where(F.col("reach") <= F.col("end") - min_words)
    first = first.select("d", "th", "i", (F.col("j") - F.col("i") + 1).alias("m"))
    last = last.select("d", "th", F.col("j").alias("i"), (F.col("i") - F.col("j") + 1).alias("m"))
    return first.unionByName(last).distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50, text: str = "text") -> DataFrame:
    """``(d, th, cuts)``: per document the line ranges to delete, merged and in order."""
    lines = materialize(_lines(docs, text), "lines")
    names = materialize(_shared(lines).dropDuplicates(AT), "names0")  # repeated rows are one document
    windows = materialize(_windows(names.select("d", "th", "i", "w"), min_words).withColumn("k", F.expr("cast(length(bin(m)) - 1 as int)")), "windows")
    most = windows.agg(F.max("k")).first()[0]
    if most is None:
        most = -1
    levels = []
    needed = windows.select("d", "th").distinct()
    names = names.join(needed, ["d", "th"], "left_semi").select(*AT, "n1", "n2")
    for k in range(most + 1):
        if k:
            half = 1 << (k - 1)
            beyond = Window.partitionBy("d", "th").orderBy("i").rangeBetween(half, half)
            pair = names.withColumn("m1", F.max("n1").over(beyond)).withColumn("m2", F.max("n2").over(beyond)).where("m1 is not null")
            names = pair.select(*AT, F.xxhash64("n1", "m1").alias("n1"), F.xxhash64("n2", F.lit(k), "m2").alias("n2"))
        names = materialize(_shared(names) if k else names, f"names{k}")
        levels.append(names.withColumn("k", F.lit(k)))
    if not levels:
        return windows.select("d", "th", F.array(F.struct(F.col("m").alias("s"), F.col("m").alias("e"))).alias("cuts"))
    names = levels[0]
    for x in levels[1:]:
        names = names.unionByName(x)

    # the name of a run: its length, and the names of its first and last 2**k lines
    first = names.select(*AT, "k", F.col("n1").alias("a1"), F.col("n2").alias("a2"))
    last = names.select("d", "th", F.col("i").alias("j"), "k", F.col("n1").alias("b1"), F.col("n2").alias("b2"))
    runs = windows.withColumn("j", F.expr("cast(i + m - shiftleft(1, k) as int)")).join(first, [*AT, "k"]).join(last, ["d", "th", "j", "k"])
    runs = materialize(runs.select("d", "th", "i", "m", "a1", "a2", "b1", "b2"), "runs")
    name = ["m", "a1", "a2", "b1", "b2"]
    origin = runs.groupBy(name).agg(F.min(F.struct(*AT)).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = runs.join(origin, name).where(F.struct(*AT) > F.col("origin")).select("d", "th", F.col("i").alias("s"), (F.col("i") + F.col("m") - 1).alias("e")).distinct()

    order = Window.partitionBy("d", "th").orderBy("s", "e")
    merged = late.withColumn("before", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("part", F.count(F.when(F.col("s") > F.col("before") + 1, 1)).over(order))
    merged = merged.groupBy("d", "th", "part").agg(F.min("s").cast("int").alias("s"), F.max("e").cast("int").alias("e"))
    return merged.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))


def _kept(text: str, cuts: str) -> str:
    """SQL for the text without the line ranges of ``cuts``."""
    until = f"if(j = size({cuts}), size(lines), {cuts}[least(j, size({cuts}) - 1)].s)"
    part = f"slice(lines, if(j = 0, 0, {cuts}[greatest(j, 1) - 1].e + 1) + 1, {until} - if(j = 0, 0, {cuts}[greatest(j, 1) - 1].e + 1))"
    join = f"array_join(flatten(transform(sequence(0, size({cuts})), j -> {part})), '\\n')"
    return f"if({cuts} is null, {text}, transform(array(split({text}, '\\n')), lines -> {join})[0])"  # split once


def _cut(docs: DataFrame, min_words: int, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text and the number of removed lines, and their columns' names."""
    integral_ids(docs)
    cuts = repeated_runs(docs, min_words, text)
    d, th, c = (fresh(x, docs.columns) for x in ("d", "th", "cuts"))
    keyed = docs.withColumn(d, F.expr("coalesce(cast(doc_id as long), -9223372036854775808L)")).withColumn(th, F.xxhash64(text))
    both = keyed.join(cuts.select(F.col("d").alias(d), F.col("th").alias(th), F.col("cuts").alias(c)).hint("shuffle_hash"), [d, th], "left")
    kept, gone = fresh("kept", both.columns), fresh("gone", both.columns)
    out = both.withColumn(gone, F.expr(f"if(`{c}` is null, 0L, aggregate(`{c}`, 0L, (a, x) -> a + x.e - x.s + 1))")).withColumn(kept, F.expr(_kept(f"`{text}`", f"`{c}`")))
    return out.select(*quoted(*docs.columns), kept, gone), kept, gone


def dedup_lines(docs: DataFrame, min_words: int = 50, text: str = "text") -> DataFrame:
    """``docs`` (all its columns) without the later copies of repeated line runs.

    A document that loses its every line is dropped; ``n_chars``, where there
    is such a column, is set anew for changed texts. Null and empty texts stay
    as they are. Rows that repeat both ``doc_id`` and text count as one document
    and are treated alike. A null ``doc_id`` comes first in the order; ids must be
    integers (an error otherwise). Columns may have any names. Words are
    maximal runs outside white space; lines end at ``\\n``. An empty table gives
    an empty result.
    """
    out, kept, gone = _cut(docs, min_words, text)
    out = out.where(f"`{gone}` = 0 or `{kept}` rlike '[^ \\t\\n\\x0B\\f\\r]'")
    changed = F.col(gone) > 0
    fixed = {text: F.col(kept)}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(fixed).select(*quoted(*docs.columns))


def dedup_report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per document ``doc_id, n_lines, n_removed, kept_chars, kept_md5``.

    Rows as in :func:`dedup_lines`, but none is dropped: a null text has no lines
    and null digests, an empty one a line. Further columns are ignored.
    """
    out, kept, gone = _cut(docs.select("doc_id", "text"), min_words, "text")
    lines = F.coalesce(F.length("text") - F.length(F.expr("replace(text, '\\n', '')")) + 1, F.lit(0))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), F.col(gone).alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.md5(F.col(kept).cast("binary")).alias("kept_md5"))


SQL = """
WITH docs AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM {docs}),
lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line,
    len(list_filter(regexp_split_to_array(string_split(text, chr(10))[i], '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, text, unnest(range(1, n + 1)) AS i FROM docs)),
pairs AS (
  SELECT a.doc_id AS d, a.i, a.w, b.doc_id AS e, a.i - b.i AS off
  FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY d, e, off ORDER BY i) AS g FROM pairs),
gone AS (
  SELECT DISTINCT d, i FROM (SELECT *, sum(w) OVER (PARTITION BY d, e, off, g) AS s FROM isles) WHERE s >= {min_words}),
kept AS (
  SELECT l.doc_id, count(g.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON g.d = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
"""
REPORT_SQL = (SQL + """
SELECT d.doc_id, coalesce(d.n, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.kept, '')) END AS kept_chars,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.kept, '')) END AS kept_md5
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
""").format(docs="documents", min_words=50)
