"""Which of many titles occur in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings

#: Characters of the n-grams by which candidates are found; every title has at least as many.
GRAM = 6
#: Of so many n-grams one is looked at; titles that have none of these are found by all of theirs.
ONE_IN = 16


def contained(texts: DataFrame, titles: DataFrame, *, key: str, text: str, title_key: str, title: str, longer_than: int = 5) -> DataFrame:
    """``(key, title_key)`` for every title of more than ``longer_than`` characters that stands in a text.

    A title's rarest n-gram finds the texts that may have it. Titles of one
    spelling are one phrase. Null texts and titles have no hits.
    """
    named = titles.where(F.length(title) > longer_than).select(F.col(title_key).alias("_id"), F.col(title).alias("_t"))
    found = postings.containing(named, texts, phrase="_t", key=key, text=text, n=max(3, min(GRAM, longer_than + 1)), one_in=ONE_IN)
    return found.select(key, F.col("_id").alias(title_key))
