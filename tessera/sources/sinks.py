"""Writing: partitioned tables, manifests, CSV of unlike rows, atomic replacement, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def named_parts(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """df with a partition value for null and blank ones."""
    return df.withColumn(column, F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(default)))


def partitioned(df: DataFrame, path: str, column: str, default: str = "unknown") -> None:
    """A folder for each value; rows of one value are gathered by a rebalancing that splits large ones."""
    named_parts(df, column, default).hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def manifest(df: DataFrame, column: str, key: str) -> DataFrame:
    """(part, n, first_key, last_key) of what partitioned would write."""
    return named_parts(df, column).groupBy(F.col(column).alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def csv_union(frames: list[DataFrame], path: str, order: str) -> None:
    """One CSV with the union of the columns of unlike frames; a cell without a value is empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.orderBy(F.col(order).try_cast("long"), order).write.mode("overwrite").csv(path, header=True, emptyValue="")


def replaced(df: DataFrame, path: str) -> None:
    """Writes beside path and then renames, so that readers see the old table or the new; the old one stays as path.bak."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".bak")
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    fs.rename(new, at)


def appended_log(df: DataFrame, path: str) -> None:
    """Adds JSON lines to an audit log."""
    df.write.mode("append").json(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
