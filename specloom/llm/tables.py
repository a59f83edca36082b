"""Reading the shared tables, the folder that all executors share, and bounded pieces of batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: Rows and bytes of text that a worker handles at once.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20
#: Row groups of intermediate tables.
ROW_GROUP_BYTES = 8 << 20


#: Column chunks are read piece by piece instead of whole, outside the heap, at once.
READING = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READING).parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Intermediate tables of this driver, in the order of writing: removed when it ends, or by ``remove_written``.
_WRITTEN: list[tuple] = []


def written_so_far() -> int:
    return len(_WRITTEN)


def remove_written(since: int = 0, but: Iterable[DataFrame] = ()) -> None:
    """Deletes the intermediate tables written after the first ``since``, except those read by ``but``;
    frames that read the others can't be used any more."""
    kept = {id(df) for df in but}
    gone, _WRITTEN[since:] = [x for x in _WRITTEN[since:] if id(x[0]) not in kept], [x for x in _WRITTEN[since:] if id(x[0]) in kept]
    for _, path, settings in reversed(gone):
        path.getFileSystem(settings).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove_written()


def written(df: DataFrame, kind: str, small: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read back: later readers share one computation,
    and a lost executor costs no more than the tasks that read from it.

    Row groups are small, as tasks hold one in memory. ``small`` says that the rows are few and short
    beside what they were made from: they go to a few files, whatever the number of partitions.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    out = df.repartition(max(2, spark.sparkContext.defaultParallelism)) if small else df
    out.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    context = spark.sparkContext
    again = spark.read.options(**READING).schema(df.schema).parquet(path)
    _WRITTEN.append((again, context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration()))
    return again


def merges(spark: SparkSession) -> bool:
    """Whether Spark puts small partitions together after a shuffle."""
    return all(spark.conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "coalescePartitions.enabled"))


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that none has more than ``rows`` rows or, but for a single longer value,
    ``most`` bytes in a text or binary column. At the end a task's free memory goes back to the system:
    idle workers hold on to little."""
    try:
        for batch in batches:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                end = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
                yield batch.slice(at, end - at)
                at = end
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
