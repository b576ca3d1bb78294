"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id where ids travel as 64-bit integers; it sorts first, as Spark sorts nulls.
NULL_ID = -(1 << 63)
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made within `scratch()`, which deletes them.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir. Unset, it is set below a local temporary folder where everything
    runs on this machine (as in tests); on a cluster that would be another folder on each machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if (made_here := _SCRATCH.get()) is not None:
        made_here.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch():
    """Gives the list that shared_dir()'s folders go to meanwhile (and then to that of a scratch() around this one); the caller
    deletes them when nothing reads them any more."""
    outer, made_here = _SCRATCH.get(), []
    token = _SCRATCH.set(made_here)
    try:
        yield made_here
    finally:
        _SCRATCH.reset(token)
        if outer is not None:
            outer.extend(made_here)


def with_row_key(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """df with a long that no two rows share, and its column's name: the document's id where ids are a key; where some are null or
    occur more than once, a number in the order of ids (null first), then of the texts' digests."""
    name = free_name("row_key", df.columns)
    ids = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"))
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").limit(1).count():
        return df.withColumn(name, F.col(f"`{doc_id}`").cast("long")), name
    by = [F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`")), F.monotonically_increasing_id()]
    dealt = df.withColumn(name, F.struct(*by)).repartitionByRange(name).sortWithinPartitions(name)
    # partitions are ranges, so numbers that rise within them and from one to the next are in order
    return written(dealt.withColumn(name, F.monotonically_increasing_id())), name


def free_name(name: str, columns: list[str]) -> str:
    """name, longer by underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later stages restart from there when executors are lost.

    Collecting the driver's garbage lets Spark delete the shuffle files of the finished write at once. What the first collection finds
    unused still holds them; they go with the second."""
    spark, path, schema = df.sparkSession, shared_dir(df.sparkSession), df.schema
    df.write.option("compression", codec).parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.05)
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def int64s(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids with NULL_ID for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... lens[0] of them, then those from starts[1], and so on."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes, spread evenly over all bits (h is overwritten)."""
    for _ in range(2):
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and UTF-8 bytes of a text column; null is empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return offs - offs[0], body


def sliced(batches, size: int, column: int = 1):
    """Record batches cut so that a column has about size bytes of text at most (a longer single text stays whole)."""
    for batch in batches:
        offs, _ = offsets_and_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def trimmed(run):
    """run, a function of batches for mapInArrow, that gives free memory back to the system at a task's end: workers live on, and what they
    keep counts beside the JVM's heap in later stages."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def made(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns that are computed once: a generator of one row, below which the optimizer moves no later step."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))))
