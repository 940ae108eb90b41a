"""Incremental stages on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import shared_dir


def run_available(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """Applies ``stage`` to the files of ``source`` that haven't been seen and appends to ``target``; returns the target.

    A batch is written under its number, so a batch that is repeated after a
    failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value): tumbling windows; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach."""


    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
