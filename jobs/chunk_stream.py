"""Keep a collection of chunks up to date with a folder that documents arrive in.

    python -m jobs.chunk_stream --source /landing/documents --out /index/chunks --checkpoint /index/chunks-checkpoint

A file stream takes the Parquet files that are new since the last run and ends
when there are no more. Documents are cut into chunks of whole lines up to a number
of words, with ids, references and concepts, and put into the collection: a
document that comes again replaces all its chunks, one that comes without text
loses them. Of several rows of one document the one in the newest file counts.

Under ``out`` there are ``increments`` (partitioned by batch: what each batch
brought), ``collection`` (partitioned by buckets of document ids: what stands now)
and ``report`` (partitioned by batch). A batch that is run again after a failure
writes the same partitions again and merges the same rows, so nothing is doubled.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.references import short_references
from corpusmill.functions.text import numbered_id, point_id, tagged, word_count
from corpusmill.operators import chunking
from corpusmill.sources import tables
from corpusmill.sources.sinks import last_of_each

CONFIG = Path(__file__).with_suffix(".json")
DOCUMENTS = "doc_id long, text string, lang string, source string"

log = logging.getLogger("jobs.chunk_stream")


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def chunks(docs: DataFrame, cap_words: int, concepts: dict[str, str]) -> DataFrame:
    """Chunks of whole lines up to ``cap_words`` words; a longer line stands alone, blank lines are none."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    paras = docs.select("doc_id", "source", "lang", lines.alias("lines"))
    packs = chunking.packs_of_lines(F.transform("lines", word_count), F.col("lines"), cap_words)
    each = paras.select("doc_id", "source", "lang", F.posexplode(packs).alias("n", "text"))
    name = numbered_id(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")), "CHUNK", F.col("n") + 1)
    return each.select(
        "doc_id",
        name.alias("chunk_id"),
        point_id(name).alias("point_id"),
        "source",
        "lang",
        word_count(F.col("text")).cast("int").alias("n_words"),
        F.array_join(tagged(F.col("text"), concepts), ",").alias("concepts"),
        F.array_join(short_references(F.col("text")), ",").alias("refs"),
        "text",
    )


def run(spark: SparkSession, source: str, out: str, checkpoint: str, *, cap_words: int = 600, buckets: int = 64, files_per_trigger: int = 1000, concepts: dict[str, str] | None = None) -> int:
    """Take what is new in ``source`` into the collection under ``out``; the number of batches that it took."""
    out = out.rstrip("/")
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    arrived = stream.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    taken = 0

    def take(batch: DataFrame, number: int) -> None:
        nonlocal taken
        session = batch.sparkSession
        last = last_of_each(batch, "doc_id", "_arrived").drop("_arrived")
        brought = chunks(last, cap_words, concepts or {}).withColumn("batch", F.lit(number))
        brought.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/increments")
        rows = session.read.schema(brought.schema).parquet(f"{out}/increments").where(F.col("batch") == number).drop("batch")
        merged = tables.replace_in_table(f"{out}/collection", rows, batch.select("doc_id"), "doc_id", buckets)
        seen = batch.agg(F.count("*").alias("rows_read"), F.count_distinct("doc_id").alias("documents"), F.count_if(~F.coalesce("text", F.lit("")).rlike(r"\S")).alias("blank")).withColumns({"chunks": F.lit(merged.rows), "buckets_rewritten": F.lit(merged.rewritten), "batch": F.lit(number)})
        seen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(f"{out}/report")
        told = session.read.json(f"{out}/report").where(F.col("batch") == number).first()
        log.info("batch %d: read %d rows of %d documents (%d blank) from %s", number, told.rows_read, told.documents, told.blank, source)
        log.info("batch %d: wrote %d chunks, %d of %d buckets rewritten, to %s", number, merged.rows, merged.rewritten, merged.buckets, out)
        taken += 1

    query = arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches from %s", taken, source)
    return taken


def collection(spark: SparkSession, out: str) -> DataFrame:
    """The chunks that stand now."""
    return tables.read_table(spark, f"{out.rstrip('/')}/collection")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from corpusmill.session import session

    spark = session("chunk_stream")
    try:
        run(spark, args.source, args.out, args.checkpoint, **config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
