"""Tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import FREED, settings

#: Bytes of an Arrow batch of texts, about.
BATCH_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []
#: Paths of tables that are held, by the identity of their DataFrames.
_path: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            drop(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one; :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; the shuffles of writing it go at once."""
    path = new_folder(df.sparkSession, name)
    with settings(df.sparkSession, **FREED):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path[id(out)] = path
    weakref.finalize(out, _path.pop, id(out), None)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once nothing that is still to be computed reads them."""
    for t in tables:
        if path := _path.pop(id(t), None):
            drop(t.sparkSession, path)
            _made.remove((t.sparkSession, path))


def quoted(*names: str) -> list[str]:
    """Column names as SQL and ``select`` take them literally, dots and all."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under plain names, as Arrow functions take no odd ones."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def integral_ids(docs: DataFrame) -> None:
    """Raise where ``doc_id`` is no integer column, as rows are keyed and ordered by it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame) -> tuple:
    """Row count and order-free hash sum; equal for equal tables."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first())


BLOOM_BITS = 1 << 24


def bloom(keys: DataFrame) -> bytes:
    """A one-hash membership bitmap of the ``long`` keys, of 2 MB at any input size.

    The words are built on the executors; at most ``BLOOM_BITS / 64`` rows come back.
    A full bitmap lets everything pass, which costs time and no result.
    """
    import numpy as np

    key = keys.columns[0]
    slot = F.expr(f"`{key}` & {BLOOM_BITS - 1}L")
    words = keys.where(F.col(key).isNotNull()).select(slot.alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63L as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").tobytes()


def in_bloom(key: str, bits: bytes) -> Column:
    """Whether the ``long`` column is among the keys of a :func:`bloom`, or shares a bit with one of them."""
    import numpy as np

    packed = F.lit(bytearray(np.packbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").tobytes()))
    byte = F.conv(F.hex(F.substring(packed, F.expr(f"cast(shiftright(`{key}` & {BLOOM_BITS - 1}L, 3) as int) + 1"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{key}` & 7L as int))")) != 0


def extend(docs: DataFrame, fn, fields: list[tuple[str, str]], text: str = "text", keep: list[str] | None = None, done=None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and the ``fields`` that ``fn`` makes of the texts.

    ``fn`` takes the UTF-8 texts of a batch (None for null) and returns one Arrow
    array per field; ``done`` is called at a task's end. Rows are neither moved
    nor reordered. Python workers outlive tasks, so what they hold is given back.
    Columns may have any names, but those of ``fields`` must be new. The bound on
    Arrow batches stays set in the session, as plans run later.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [*keep, *(name for name, _ in fields)]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash: {names}")

    def run(it):
        try:
            for batch in it:
                texts = batch.column(0).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *fn(texts)], names)
        finally:
            if done is not None:
                done()
            pa.default_memory_pool().release_unused()

    schema = ", ".join([f"{c} {kinds[k]}" for c, k in zip(quoted(*keep), keep, strict=True)] + [f"{quoted(c)[0]} {kind}" for c, kind in fields])
    return numbered(docs.select(F.col(*quoted(text)).alias(fresh("_text_", docs.columns)), *quoted(*keep))).mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session in bytes, for texts of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column has it (in any case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def release() -> None:
    """Delete all tables of this process, once no result that reads them is needed any more."""
    while _made:
        drop(*_made.pop())
