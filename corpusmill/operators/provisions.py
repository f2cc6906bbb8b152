"""Statute sections: merging, atomic units, assembly, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"subsections": "subsection", "explanations": "explanation", "exceptions": "exception", "provisos": "proviso", "illustrations": "illustration"}


def merge_sections(raw: DataFrame, key: str, order: str, first: list[str], text: str, arrays: list[str]) -> DataFrame:
    """One row per section: scalars of the first fragment that has them, texts that aren't part of the text so far, arrays in order without repeats."""
    piece = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    joined = F.aggregate(piece, F.lit(""), lambda a, x: F.when((x["_t"] == "") | F.contains(a, x["_t"]), a).when(a == "", x["_t"]).otherwise(F.concat(a, F.lit("\n"), x["_t"])))
    scalars = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    lists = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(a).alias("_a")))), lambda x: x["_a"]))).alias(a) for a in arrays]
    return raw.groupBy(key).agg(*scalars, joined.alias(text), *lists)


def label_numbers(items: Column, letters: bool = False) -> Column:
    """Numbers of labelled items: of the label, of the text, or of the place; letters in brackets first where asked."""

    def of(x: Column, i: Column) -> Column:
        label, text = F.coalesce(x["label"], F.lit("")), F.coalesce(x["text"], F.lit(""))
        own = F.nullif(F.regexp_extract(label, r"\b(\d+)\b", 1), F.lit(""))
        if letters:
            found = F.regexp_extract_all(text, F.lit(r"\(([a-z])\)"))
            return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(own, (i + 1).cast("string"))))
        return F.array(F.coalesce(own, F.nullif(F.regexp_extract(text, r"^\s*(\d+)\b", 1), F.lit("")), (i + 1).cast("string")))

    return F.array_distinct(F.flatten(F.transform(items, of)))


def labelled(items: Column, plain: tuple[str, ...], name: str) -> Column:
    """``Label: text`` of each item; plain labels are numbered where there are several."""

    def of(x: Column, i: Column) -> Column:
        label = F.regexp_replace(F.trim(F.coalesce(x["label"], F.lit(name))), "[.:]+$", "")
        label = F.when(F.lower(label).isin(*plain), F.when((F.size(items) > 1) & F.lit(name != "Provided that"), F.concat(F.lit(f"{name} "), (i + 1).cast("string"))).otherwise(name)).otherwise(label)
        text = F.trim(F.coalesce(x["text"], F.lit("")))
        return F.when(text == "", "").when(text.startswith(label), text).otherwise(F.concat(label, F.lit(": "), text))

    return F.filter(F.transform(items, of), lambda x: x != "")


def assembled(number: Column, title: Column, main: Column, *parts: Column) -> Column:
    """The text of a section: heading, main text, then its labelled parts."""
    head = F.regexp_replace(F.concat(F.lit("Section "), number, F.lit(" - "), F.coalesce(title, F.lit(""))), "^[ -]+|[ -]+$", "")
    return F.array_join(F.filter(F.concat(F.array(head, F.coalesce(main, F.lit(""))), *parts), lambda x: x != ""), "\n\n")


def cleaned(text: Column) -> Column:
    """One line without the usual faults of scanning."""
    from ..functions.rules import SCAN_REPAIRS
    from ..functions.text import rewritten

    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]", " "), "�", "")
    t = rewritten(t, [(f"(?i){p}", r) for p, r in SCAN_REPAIRS])
    return F.trim(F.regexp_replace(F.regexp_replace(t, "([a-zA-Z]),([a-zA-Z])", "$1, $2"), "[ \t\n\r]+", " "))


def atomic_units(sections: DataFrame, key: str = "section_id", kinds: dict[str, str] | None = None) -> DataFrame:
    """One row per unit: the section itself and every item of its arrays, in one pass over the table."""
    kinds = kinds or {k: v for k, v in KINDS.items() if k in sections.columns}
    unit = lambda kind, no, text: F.struct(F.lit(kind).alias("unit_type"), no.cast("string").alias("unit_number"), text.alias("text"))
    own = F.array(unit("section", F.lit("0"), F.col("text")))

    def items(c: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.expr("cast(array() as array<struct<label:string,text:string>>)")), lambda x, i: unit(kind, i + 1, x["text"]))

    arrays = [items(c, kind) for c, kind in kinds.items()]
    return sections.select(key, F.explode(F.concat(own, *arrays)).alias("u")).select(key, "u.*").where("trim(coalesce(text, '')) <> ''")


def completeness(expected: DataFrame, found: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Per expected row whether it was found and whether its distinct counts agree."""
    f = found.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in counts))
    out = expected.join(f, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull(), "missing")
    for c in counts:
        status = status.when(F.coalesce(c, F.lit(0)) != F.coalesce(f"_{c}", F.lit(0)), f"{c}_differ")
    return out.withColumn("status", status.otherwise("complete")).drop("_k", *(f"_{c}" for c in counts))
