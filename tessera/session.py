"""Spark session settings that the queries assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Time zone, adaptive execution and skew handling; partition counts are the caller's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session; master local[*] and as many shuffle partitions as cores unless given."""
    builder = SparkSession.builder.appName("tessera").master(master or "local[*]")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions or os.cpu_count() or 8)} | more
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
