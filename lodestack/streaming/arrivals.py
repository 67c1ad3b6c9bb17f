"""Findings of files as they arrive, and counts of events by time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def on_arrival(spark: SparkSession, folder: str, schema: str, analysis: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run an analysis of `files` rows over new Parquet files of a folder and append its findings; each file once, across restarts."""

    def batch(df: DataFrame, epoch: int) -> None:
        analysis(df).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and kind; on a stream, rows later than `late` are left out."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_t", window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
