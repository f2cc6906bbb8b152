"""Incremental upserts of streamed documents (an extension: the engine is a batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.sinks import upsert


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, checkpoint: str, order: str | None = None):
    """Every micro-batch merged into a table by key. ``write`` gets the new state and the batch's number.

    Of rows of one key in a batch the last by ``order`` counts, and by the other
    columns where that ties. Replaying a batch gives the same table, so a restart
    does no harm.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch, key, order), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
