"""Structured Streaming over the event table: windows, late data, deduplication, incremental postings.

The work the library derives from has no streams; these are extensions (ext_), each equal to a batch query over the
same rows.  A source directory of Parquet files is read with availableNow, so that a run ends when all is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def absolute(ts: Column) -> Column:
    """A time without zone as the moment it is in UTC, whatever the session's zone; windows begin on UTC days."""
    return F.concat(ts.cast("string"), F.lit("+00:00")).cast("timestamp")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events of a directory; ts as a timestamp, which watermarks need."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", absolute(F.col("ts")))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", absolute(F.col("ts")))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by windows of a size."""
    rows = events.withWatermark("ts", "2 days") if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", "2 days") if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, stop, n): runs of events with no longer gap."""
    rows = events.withWatermark("ts", "2 days") if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    rows = events.withWatermark("ts", "2 days")
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All rows of a streaming result, written as a table in the shared folder once its source is read."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tessera-stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def merged_postings(stream: DataFrame, path: str) -> None:
    """Adds each batch's counts of (user_id, event_type) to a log of increments that readers sum up: a batch that runs
    again writes its own folder again."""

    def put(df: DataFrame, epoch: int) -> None:
        df.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
