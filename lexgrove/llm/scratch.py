"""Tables that cut lineage, written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to Python, about. Spark's own bound is 10000 rows, 26 MB of these texts, of which the JVM and the worker hold copies at once.
BATCH = 4 << 20

_written: list[tuple[SparkSession, str]] = []


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexgrove-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return base.rstrip("/")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when Python ends."""
    path = f"{shared_folder(spark)}/lexgrove/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # no _SUCCESS: nobody waits for one, and without Hadoop's native library each local file makes the driver's JVM start two chmods, which share its memory until they run
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(build: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The table that build gives, stored, and its path; the tables that were written on the way are removed."""
    start = len(_written)
    done = materialize(build(), name)
    path = _written.pop()[1]
    for spark, old in _written[start:]:
        remove(spark, old)
    _written[start:] = [(done.sparkSession, path)]
    return done, path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a stored table whose consumers are stored."""
    remove(spark, path)
    _written.remove((spark, path))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the table's bytes, at least 1."""
    return max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python are bounded. Results are read later, so the bound stays with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def give_back() -> None:
    """Freed memory that Arrow and the C library keep for later goes back to the system, as Python shares the driver's with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives its freed memory back: Spark keeps idle workers, and they share the executor's memory with the JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone by now; the folder then is the cluster's to clean
            return
