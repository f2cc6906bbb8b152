"""Idempotent writes: merge, insert, delete, rebuild, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5


def last_of_each(source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``, and by all other columns where that ties."""
    row = F.struct(*([order] if order else []), *(c for c in source.columns if c not in (key, order)))
    return source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row")).select(key, "_row.*")


def accepted(source: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Rows without a blank text; blank keys get one that the rest of the row tells, the same at every replay."""
    if text is not None:
        source = source.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\S"))
    if source.schema[key].dataType.simpleString() == "string":
        source = source.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) == "", uuid5(F.to_json(F.struct(*(c for c in source.columns if c != key))))).otherwise(F.col(key)))
    return source


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None, text: str | None = None) -> DataFrame:
    """The target with the source's rows in place of those of equal keys; the last of each key counts.

    Rows with a null key are left out, as are those with a blank ``text`` where
    a text column is named; a blank string key becomes one of the row's content,
    so equal rows without a key are one row and a replay changes nothing.
    """
    source = last_of_each(accepted(source, key, text), key, order)
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def inserted(source: DataFrame, key: str, text: str | None = None) -> int:
    """How many rows an upsert of ``source`` writes."""
    return accepted(source, key, text).where(F.col(key).isNotNull()).select(key).distinct().count()


def insert_if_absent(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The target with those rows of the source whose key is new, the last of each."""
    new = last_of_each(source, key, order).join(target.select(key).distinct(), key, "left_anti")
    return target.unionByName(new.select(*target.columns))


def merged(target: DataFrame, source: DataFrame, key: str, overwrite: bool, order: str | None = None) -> DataFrame:
    """An upsert where rows may be overwritten, otherwise an insert of new keys only."""
    return upsert(target, source, key, order) if overwrite else insert_if_absent(target, source, key, order)


def delete(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti").select(*target.columns)


def replace_documents(chunks: DataFrame, new: DataFrame, document: str) -> DataFrame:
    """Chunks with all those of the given documents replaced, so that no old tail stays."""
    kept = chunks.join(new.where(F.col(document).isNotNull()).select(document).distinct(), document, "left_anti")
    return kept.select(*chunks.columns).unionByName(new.where(F.col(document).isNotNull()).select(*chunks.columns))


def rejected(df: DataFrame, *rules: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and refused ones with the first reason."""
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in rules))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def page_dump(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Texts of documents with their page marks, for ``write.text``."""
    part = F.struct(page, F.concat(F.lit("--- PAGE "), F.col(page).cast("string"), F.lit(" ---\n"), F.coalesce(text, F.lit(""))).alias("_t"))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "\n\n").alias("text"))


def report(df: DataFrame) -> DataFrame:
    """One JSON line per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def text_report(df: DataFrame, key: str) -> DataFrame:
    """One line of text per row, ``key: name=value, ...``, for ``write.text``; nulls are ``-``."""
    shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns if c != key]
    return df.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(": "), F.concat_ws(", ", *shown)).alias("value"))
