"""Filters and assembly around generated answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CURRENT_ACTS, PROCEDURAL_IDS, PROCEDURAL_TITLES, SUPERSEDED_ACTS


def allow_listed(sources: Column, valid: Column) -> Column:
    """The cited sources that were retrieved, in their order."""
    return F.filter(F.coalesce(sources, F.expr("cast(array() as array<string>)")), lambda s: F.array_contains(valid, s))


def validate_answers(answers: DataFrame, sources: str = "sources", valid: str = "valid_ids", out_of_scope: str = "out_of_scope") -> DataFrame:
    """Only retrieved sources stay; an answer that keeps none counts as out of scope."""
    out = answers.withColumn(sources, allow_listed(F.col(sources), F.col(valid)))
    return out.withColumn(out_of_scope, F.coalesce(F.col(out_of_scope), F.lit(False)) | (F.size(sources) == 0))


def drop_procedural(candidates: DataFrame, source_id: str = "source_id", title: str = "title", ids: tuple[str, ...] = PROCEDURAL_IDS, keywords: tuple[str, ...] = PROCEDURAL_TITLES) -> DataFrame:
    """Without candidates whose id is blocked or whose title names a procedure."""
    named = F.lit(False)
    for word in keywords:
        named = named | F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(word))
    blocked = F.coalesce(F.col(source_id), F.lit("")).isin(*ids)
    return candidates.where(~blocked & ~named)


def prefer_current(candidates: DataFrame, group: str, act: Column, current: tuple[str, ...] = CURRENT_ACTS, superseded: tuple[str, ...] = SUPERSEDED_ACTS) -> DataFrame:
    """In groups with a row of a current act, without rows of superseded ones."""
    upper = F.upper(act)
    some = F.max(F.coalesce(upper.isin(*(a.upper() for a in current)), F.lit(False))).over(Window.partitionBy(group))
    old = F.coalesce(upper.isin(*(a.upper() for a in superseded)), F.lit(False))
    return candidates.withColumn("_some", some).where(~(F.col("_some") & old)).drop("_some")


def enrich(candidates: DataFrame, known: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Candidates that are known, with blanks filled from what is known of them."""
    k = known.dropDuplicates([on]).select(on, *(F.col(c).alias(f"_{c}") for c in columns))
    out = candidates.join(k, on)
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}") if c in candidates.columns else F.col(f"_{c}"))
    return out.drop(*(f"_{c}" for c in columns))


def nullify_dangling(candidates: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    """References to rows that were not retrieved become null."""
    k = known.select(F.col(key).alias("_known")).where("_known is not null").distinct()
    out = candidates.join(k, F.col(column) == F.col("_known"), "left")
    return out.withColumn(column, F.when(F.col("_known").isNotNull(), F.col(column))).drop("_known")


def cited_flag(sources: Column, key: Column) -> Column:
    return F.coalesce(F.array_contains(sources, key), F.lit(False))


def build_context(cards: DataFrame, group: str, order: list[str], line: Column, cap: int, separator: str = "\n\n") -> DataFrame:
    """Per group its lines, each cut to ``cap`` characters, joined in order."""
    piece = F.struct(*order, F.substring(line, 1, cap).alias("_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["_line"]), separator)
    return cards.groupBy(group).agg(text.alias("context"), F.count("*").alias("n_parts"))


def with_fallback(*providers: Callable, tries: int = 2, delay: float = 1.5) -> Callable:
    """A function for ``mapInPandas`` out of providers, each a function of one batch: the first is tried
    ``tries`` times, ``delay`` seconds apart, then the next; the last one's error is raised."""

    def run(batches):
        import time

        for pdf in batches:
            error = None
            for provider in providers:
                for attempt in range(tries):
                    try:
                        out = provider(pdf)
                        break
                    except Exception as e:  # whatever a remote provider raises
                        error = e
                        if attempt + 1 < tries:
                            time.sleep(delay)
                else:
                    continue
                break
            else:
                raise error
            yield out

    return run


def answer(questions: DataFrame, respond: Callable | None = None) -> DataFrame:
    """Answers through a pluggable ``mapInPandas`` function; without one, the offline answer cites all it was given."""
    if respond is not None:
        return questions.mapInPandas(respond, questions.schema.simpleString()[7:-1] + ",answer:string,sources:array<string>,out_of_scope:boolean")
    return questions.withColumn("answer", F.substring("context", 1, 400)).withColumn("sources", F.col("valid_ids")).withColumn("out_of_scope", F.size("valid_ids") == 0)
