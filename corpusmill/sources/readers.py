"""File sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: str, malformed: str | None = None) -> DataFrame:
    """One document per line; blank lines are none.

    Large files are read in parts. A line that is no JSON gives a row of nulls;
    with ``malformed``, that line stands in a column of this name, null for others.
    """
    if malformed is None:
        return spark.read.schema(schema).json(path)
    lines = spark.read.schema(f"{schema}, `{malformed}` string").option("columnNameOfCorruptRecord", malformed).json(path)
    return lines.where(F.coalesce(F.col(malformed), F.lit("x")).rlike(r"\S"))


def page_dumps(spark: SparkSession, path: str, marker: str = "--- PAGE ") -> DataFrame:
    """``(file_name, page_number, text)`` of text files with page marks, a file as a whole in one row until it is cut."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return text_pages(files, "file_name", "value", marker)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of some folders that holds files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and len(fs.listStatus(path)):
            return p
    raise FileNotFoundError(", ".join(paths))


def text_pages(df: DataFrame, doc: str, text: str, marker: str = "--- PAGE ") -> DataFrame:
    """``(doc, page_number, text)`` out of dumps with page marks, by the numbers that the marks tell."""
    mark = rf"(?m)^\Q{marker}\E(\d+) ---\n?"
    numbers = F.regexp_extract_all(text, F.lit(mark))
    parts = F.split(F.col(text), mark)
    pages = F.arrays_zip(numbers.alias("n"), F.slice(parts, F.lit(2), F.size(numbers)).alias("t"))
    return df.select(doc, F.explode(pages).alias("p")).select(doc, F.col("p.n").cast("int").alias("page_number"), F.regexp_replace("p.t", r"\n*$", "").alias("text"))


def binary_files(spark: SparkSession, path: str, magic: bytes = b"%PDF", larger_than: int = 10_000) -> DataFrame:
    """Files of a kind and a least size, for a parser in ``mapInPandas``."""
    df = spark.read.format("binaryFile").load(path)
    return df.where((F.col("length") > larger_than) & (F.substring("content", 1, len(magic)) == F.lit(magic)))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key that isn't empty."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(order), *(F.desc(c) for c, kind in df.dtypes if c not in (key, order) and "map<" not in kind))
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
