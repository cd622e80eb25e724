"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII blanks.
WORD_RE = r"[^\x20\x09-\x0D]+"
_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str) -> list[str]:
    """The runs of non-blanks, where only space and \\t \\n \\v \\f \\r are blanks (str.split() knows more)."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_BLANKS).split(" ") if w]


#: Bytes of an Arrow batch, where the session does not set another bound.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts do not add up in a Python worker. A bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def trimmed(run):
    """The mapper, giving the memory that it freed back to the system when a task ends: workers live on, and others need it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may leave it unset, and gets a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="flowlark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_written: dict[int, tuple[DataFrame, str]] = {}


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    group_bytes: size of row groups, for tables of large rows whose reads should be split finely.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowlark-{name}-{uuid.uuid4().hex}"
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once all that was derived from them is written."""
    for t in tables:
        kept = _written.pop(id(t), None)
        if kept is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(kept[1])
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(col, n: int):
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))
