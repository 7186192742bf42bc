"""Resumable micro-batch ingest and event-time windows with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_stream(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 1, stop: Callable[[], bool] = lambda: False, deadline: float | None = None) -> str:
    """Takes the Parquet files of ``source`` in batches, writes each under its
    batch number in ``target`` (a replayed batch replaces itself), and last of all
    notes it as committed. Between batches it ends when ``stop`` says so or
    ``deadline`` (seconds) has passed, never before the first; a ``stop`` that
    fails counts as no. Returns 'done', 'stopped' or 'time'."""
    began, batches, outcome = time.monotonic(), 0, "done"

    def asked() -> bool:
        try:
            return stop()
        except Exception:  # a lost answer means: go on
            return False

    def write(df: DataFrame, batch: int) -> None:
        nonlocal batches
        write_in_order(df, batch, target, [("data", transform)])
        batches += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if asked():
        return "stopped"
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    seen = 0
    while not query.awaitTermination(0.2):
        if batches > seen:
            seen = batches
            if asked():
                outcome = "stopped"
            elif deadline is not None and time.monotonic() - began > deadline:
                outcome = "time"
            if outcome != "done":
                query.stop()
                break
    return outcome


def write_in_order(df: DataFrame, batch: int, target: str, sinks: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> None:
    """One batch into several tables, in their order, and its mark last. A batch has a folder
    of its own in each table, so writing it again replaces what an attempt before has left."""
    for name, transform in sinks:
        transform(df).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{target}/committed/batch_{batch}")
    # batches come in order, so the last marks tell for all before them
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop.Path(f"{target}/committed/batch_{batch - 2}")
    if fs.exists(old):
        fs.delete(old, True)


def run_ordered(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, sinks: list[tuple[str, Callable[[DataFrame], DataFrame]]], files_per_batch: int = 1) -> None:
    """Takes the Parquet files of ``source`` in batches and each batch into all ``sinks``
    (name, transform). Whatever ends a run, between two tables too, the next one takes the
    batch without a mark again, and readers of ``committed`` see it in all tables or in none."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, batch: write_in_order(df, batch, target, sinks)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def committed(spark: SparkSession, target: str, name: str = "data") -> DataFrame:
    """The rows of a table's committed batches, and nothing else."""
    marks = spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{target}/committed")
    last = marks.agg(F.max("batch").alias("last_"))  # a row
    rows = spark.read.parquet(f"{target}/{name}")
    return rows.join(F.broadcast(last), F.col("batch") <= F.col("last_")).select("batch", *[c for c in rows.columns if c != "batch"])


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned time."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """n and total per window; works on a stream and on a table alike."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    per = event_time(df).withWatermark("ts", late).groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    per = event_time(df).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return per.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return event_time(df).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def replayed(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """A stream's result over all files there are, as a table in memory; for reports of bounded size."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def stalled(status: Column, updated: Column, now: Column, minutes: int = 20) -> Column:
    return status.isin("queued", "running") & (updated < now - F.expr(f"INTERVAL {minutes} MINUTES"))
