"""Streaming inbox of files, and the states of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE = "path string, modificationTime timestamp, length long, content binary"
# States in their order.
STATES = ("Pending", "Running", "Completed", "Failed")


def incoming(spark: SparkSession, folder: str, pattern: str = "*.txt", files: int = 100, archive: str | None = None) -> DataFrame:
    """New files of a folder; a checkpoint remembers which were seen. Files that are done move to the archive, if one is given."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(folder)


def outcomes(batch: DataFrame, ok: Column) -> DataFrame:
    """path, folder: where each file of a batch belongs, done or failed."""
    return batch.select("path", F.when(F.coalesce(ok, F.lit(False)), "done").otherwise("failed").alias("folder"))


def kept_jobs(states: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Jobs except those that ended longer ago than the limit."""
    ended = F.col("status").isin(*STATES[2:]) & ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6 > seconds)
    return states.where(~F.coalesce(ended, F.lit(False)))


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 10) -> StreamingQuery:
    """Hand each batch to a function, every so many seconds, or once over all that is there."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def job_states(log: DataFrame) -> DataFrame:
    """The state of each job from its log (job_id, status, updated_at, error): a final state stays, else the latest counts."""
    order = F.when(F.col("status").isin(*STATES[2:]), 1).otherwise(0)
    latest = log.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at", "error"), F.struct(order, "updated_at")).alias("s"))
    return latest.select("job_id", "s.*")


def live_progress(events: DataFrame, ttl: str = "300 seconds") -> DataFrame:
    """Counts by job and window of the given length, from a stream of (job_id, ts, status) with late events allowed as long."""
    return events.withWatermark("ts", ttl).groupBy(F.window("ts", ttl), "job_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))


def progress(chunks: DataFrame) -> DataFrame:
    """job_id, done, total, percent of chunk states."""
    done = F.count_if(F.col("status") == "Completed")
    return chunks.groupBy("job_id").agg(done.alias("done"), F.count(F.lit(1)).alias("total"), F.round(100 * done / F.count(F.lit(1)), 2).alias("percent"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with gaps up to gap_seconds: key, session, start, end, events."""
    order = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) > gap_seconds * 1_000_000, F.lit(True))
    marked = events.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events"))
