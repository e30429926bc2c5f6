"""The audit log as a stream: windowed counts, bursts, deduplicated jobs, a queue with retries, stale sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files below path as they come."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str | None = "action") -> DataFrame:
    """start, by, n, users (approximate) in tumbling or sliding windows, of all events when by is None; events over late are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    keys = [by] if by else []
    counts = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events with pauses under gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(events: DataFrame, action: str = "error", length: str = "1 hour", least: int = 3, late: str = "10 minutes") -> DataFrame:
    """Users with that many of the action in a window."""
    hits = F.count_if(F.col("action") == action)  # a filter would be pushed below the watermark, which all events are to move
    found = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "user_id").agg(hits.alias("n"))
    return found.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "user_id", "n")


def first_jobs(jobs: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """Each job, by its keys (id when none are named), once within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys) or ["id"])


def retried(jobs: DataFrame, most: int = 3) -> DataFrame:
    """job, tries, state (done, waiting, failed) after each of a job's attempts; jobs has job, ok. State is a counter per job."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tries, now = state.get if state.exists else (0, "waiting")
        for batch in rows:
            for ok in batch.ok:
                if now == "waiting":
                    tries += 1
                    now = "done" if ok else "failed" if tries >= most else "waiting"
        state.update((tries, now))
        yield pd.DataFrame({"job": [key[0]], "tries": [tries], "state": [now]})

    return jobs.groupBy("job").applyInPandasWithState(step, "job long, tries int, state string", "tries int, now string", "update", "NoTimeout")


def stale(beats: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """Sources whose last beat is older than that at now."""
    last = beats.groupBy("source").agg(F.max("ts").alias("last"))
    return last.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") > seconds)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now through the streaming plan, into a memory table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives each micro-batch to write; a batch may come again after a failure, with its number."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a folder of files with those that come to it, or one file, which the source takes as a pattern only."""
    return stream(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema, files_per_trigger)


def _landing(df: DataFrame, path: str, mode: str):
    """A started query that writes each batch below path, with its number; what comes again after a failure overwrites what came before."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def _rows(df: DataFrame, path: str, mode: str) -> DataFrame:
    spark, rows = df.sparkSession, f"{path}/rows"
    at = spark._jvm.org.apache.hadoop.fs.Path(rows)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], df.schema)  # no batch came
    out = spark.read.parquet(rows)
    return out.drop("batch") if mode == "append" else out


def landed(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What the streaming plan gives for all that is there now, as a table below path; its checkpoint lies there too.

    append: rows that are final. update: each batch's rows, with its number in batch. complete: the state after the last
    batch. A batch that comes again after a failure overwrites what it wrote before.
    """
    _landing(df, path, mode).awaitTermination()
    return _rows(df, path, mode)


def landed_while(df: DataFrame, path: str, go: Callable[[int], bool], mode: str = "append", poll: float = 0.2) -> bool:
    """landed() that can be stopped: go gets the number of batches that are done, and ends the query when it says no. True when all that was there has come.

    The query stops between batches or within one, whose jobs are cancelled. The next call with the same path goes on from the checkpoint: the batch that was cut short
    comes again under its number, so that no row is lost and none comes twice.
    """
    query = _landing(df, path, mode)
    while not query.awaitTermination(poll):
        last = query.lastProgress
        if not go(0 if last is None else last["batchId"] + 1):
            query.stop()
            query.awaitTermination()
            return False
    return True


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that the block starts in this thread bear the tag, by which cancel() finds them from any other."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs that bear the tag; their blocks get an error. What they had not committed is gone, other work goes on."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(query) -> dict:
    """Rows, rate and batch of the last trigger."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId"), "rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond")}
