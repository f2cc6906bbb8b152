"""Structure of paged and headed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import JUDGMENT_ENDS, PAGE_NOISE, SECTION_HEADINGS, TOPIC_HEADING


def noisy(line: Column, page: Column | None = None, at: Column | None = None) -> Column:
    """Page headers, footers and numbers; among the first lines of later pages, party names too."""
    out = F.lit(False)
    for p in PAGE_NOISE:
        out = out | line.rlike(f"(?i){p}")
    if page is not None and at is not None:
        out = out | ((page > 1) & (at < 4) & line.rlike(r"(?i)\bv\.\s|\bversus\b"))
    return out


def repeated_edge_lines(lines: DataFrame, group: str, page: str, at: str, line: str, least: int = 15, edge: int = 3) -> DataFrame:
    """Lines that stand among the first or last of many pages: ``(group, line, n)``.

    A line counts once for the head and once for the foot of a page. It is
    repeated from ``max(3, half of the pages)`` on.
    """
    some = lines.where(F.trim(line) != "")
    w = Window.partitionBy(group, page)
    some = some.withColumn("_up", F.row_number().over(w.orderBy(at))).withColumn("_down", F.row_number().over(w.orderBy(F.desc(at))))
    times = (F.col("_up") <= edge).cast("int") + (F.col("_down") <= edge).cast("int")
    edges = some.withColumn("_n", times).where((F.col("_n") > 0) & (F.length(line) >= least) & ~F.col(line).rlike(r"^\d+$"))
    counts = edges.groupBy(group, line).agg(F.sum("_n").cast("long").alias("n"))
    pages = lines.groupBy(group).agg(F.greatest(F.lit(3), F.ceil(F.count_distinct(page) / 2)).alias("_least"))
    return counts.join(pages, group).where(F.col("n") >= F.col("_least")).drop("_least")


def heading(line: Column) -> Column:
    """The section that a heading line opens, null for other lines."""
    plain = F.trim(F.regexp_replace(F.upper(line), "[^A-Z0-9]+", " "))

    def of(h: Column) -> Column:
        has = lambda s: F.contains(h, F.lit(s))
        alone = F.replace(h, F.lit(" "), F.lit("")).isin("JUDGMENT", "ORDER")
        out = None
        for words, section in SECTION_HEADINGS:
            opens = (h == words) | h.startswith(f"{words} ") if section == "headnotes" else has(words)
            out = F.when(opens, section) if out is None else out.when(opens, section)
        return out.when((has("JUDGMENT") | has("ORDER")) & (has("SUPREME COURT") | alone), "judgment")

    return F.transform(F.array(plain), of)[0]  # the line is made plain once


def carried(df: DataFrame, group: list[str], order: list[str], marker: Column, value: Column, into: str) -> DataFrame:
    """The value of the last row up to here at which ``marker`` holds."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(F.when(marker, value), ignorenulls=True).over(w))


def section_buckets(lines: DataFrame, group: str, order: list[str], line: str = "line") -> DataFrame:
    """Lines with their section; a judgment goes on over headings until a line that ends it."""
    end = F.lit(False)
    for mark in JUDGMENT_ENDS:
        end = end | F.contains(F.col(line), F.lit(mark))
    df = lines.withColumn("_h", heading(F.col(line))).withColumn("_end", end)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_j", F.last(F.when(F.col("_end"), F.lit(0)).when(F.col("_h") == "judgment", F.lit(1)), ignorenulls=True).over(w))
    df = carried(df, [group], order, F.col("_h").isNotNull() & (F.coalesce("_j", F.lit(0)) == 0) | (F.col("_h") == "judgment") | F.col("_end"), F.when(F.col("_end"), "").otherwise(F.col("_h")), "_s")
    section = F.when(F.col("_j") == 1, "judgment").when(F.col("_s") != "", F.col("_s"))
    opens = F.col("_h").isNotNull() & ((F.col("_j").isNull()) | (F.col("_j") == 0) | ((F.col("_h") == "judgment") & (F.lag("_j").over(Window.partitionBy(group).orderBy(*order)).isNull() | (F.lag("_j").over(Window.partitionBy(group).orderBy(*order)) == 0))))
    return df.withColumn("section", section).withColumn("_opens", opens).where(~F.col("_opens") & ~F.col("_end") & F.col("section").isNotNull()).drop("_h", "_end", "_j", "_s", "_opens")


_PARAS = r"\[\s*Paras?\s+([\d,\s\-]+)\s*\]"


def paragraph_ranges(text: Column) -> Column:
    """Numbers of ``3, 5-7`` in order, ranges written out."""
    item = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+(-\d+)?$"))
    out = F.transform(item, lambda x: F.when(x.contains("-"), F.when(F.substring_index(x, "-", 1).cast("int") <= F.substring_index(x, "-", -1).cast("int"), F.sequence(F.substring_index(x, "-", 1).cast("int"), F.substring_index(x, "-", -1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))).otherwise(F.array(x.cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(out)))


def propositions(text: Column) -> Column:
    """Headnote propositions ``struct<heading, text, related_paragraphs>``, cut after their paragraph marks."""
    marked = F.regexp_replace(text, r"(\[\s*Paras?\s+[\d,\s\-]+\s*\])", "$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\s*\n\s*", " "))), lambda x: x != "")

    def of(x: Column) -> Column:
        has = x.rlike(_PARAS)
        heads = F.transform(F.split(x, "–"), lambda h: F.trim(h))
        first = F.element_at(heads, 1)
        head = F.when(has & (F.size(heads) > 1) & (F.length(first) < 30), F.concat(first, F.lit(" – "), F.coalesce(F.try_element_at(heads, F.lit(2)), F.lit("")))).otherwise(first)
        related = F.when(has, paragraph_ranges(F.regexp_extract(x, _PARAS, 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.struct(head.alias("heading"), x.alias("text"), related.alias("related_paragraphs"))

    return F.transform(parts, of)


def topics(text: Column) -> Column:
    """Entries of a headnote that end in a paragraph mark, white space squeezed.

    Without any mark, an entry begins at each line that opens with a heading.
    """
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    marked = F.split(F.regexp_replace(text, r"(\[Paras?\s+[^\]]+\])", "$1\u0001"), "\u0001")
    found = F.filter(F.transform(marked, squeeze), lambda x: x.rlike(r"\[Paras?\s+[^\]]+\]$"))
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    headed = F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(TOPIC_HEADING), F.concat(F.lit("\u0001"), x)).otherwise(x))
    entries = F.filter(F.transform(F.split(F.array_join(headed, " "), "\u0001"), squeeze), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(entries)


def list_items(text: Column) -> Column:
    """Items of a citation list without bullets, headers, footnotes and page numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s•·\-–—]+", "")))
    bad = r"Supreme Court Reports|^\[\d{4}\]\s*\d+\s*[Ss]\.[Cc]\.[Rr]\.|^\d{1,2}\s*\[\d{4}\]|^\d{3,5}\x08?$"
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(bad))
