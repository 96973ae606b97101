"""Helpers shared by the training-data operators: shared folder, lineage cuts, Arrow batch limits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grainsift.session import reach_workers, shared_folder

FILE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session."""
    return shared_folder(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_cols: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and reread it: a lineage cut that survives lost executors.

    most_bytes: what the rows of df hold at most. A small table then goes into few files of FILE_BYTES or so instead of one for
    every partition; on a local file system each file costs the executor several helper processes.
    """
    path = work_path(df.sparkSession, name)
    if most_bytes is not None:
        df = df.coalesce(max(1, -(-most_bytes // FILE_BYTES)))
    w = df.write
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path  # noqa: SLF001 - read by discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    path = getattr(df, "_work_path", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, mbytes: int = 8) -> None:
    """Keep Arrow batches small in bytes, so that runs of very long texts don't pile up in a Python worker."""
    reach_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mbytes << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A bounded memo of make(key): when full, it becomes the old generation, from which keys in use come back."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit // 2, longest, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


@contextlib.contextmanager
def without_cycle_collection() -> Iterator[None]:
    """Large tables of strings in a worker hold no cycles, but every full collection walks them; none run inside."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back_memory() -> None:
    """Return what a finished step has freed to the system; a worker process lives on for other steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
