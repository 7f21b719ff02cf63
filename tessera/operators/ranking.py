"""Ranks, shares, matrices, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order: Column | str, by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """df with a row number from 1 within groups of by."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def top(df: DataFrame, k: int, *order: Column | str, by: list[str]) -> DataFrame:
    return numbered(df, *order, by=by).where(F.col("rn") <= k)


def ranks(df: DataFrame, key: str, *values: str) -> DataFrame:
    """df with a global rank for each value, highest first, ties by key.

    Rows are sorted over the cluster by range and numbered with each partition's offset, so that no one task
    sorts all rows."""
    out = df
    for v in values:
        out = out.join(global_numbers(df.select(key, v), F.desc(v), F.col(key)).select(key, F.col("number").alias(f"rank_{v}")), key)
    return out


def global_numbers(df: DataFrame, *order: Column) -> DataFrame:
    """df with number, its place from 1 in a global order."""
    from tessera.operators.graph import stored

    ordered = stored(df.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = ordered.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    return own.withColumn("number", F.col("before") + F.col("pos") - F.shiftleft(F.col("part").cast("long"), 33) + 1).drop("part", "pos", "before")


def shares(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """df with each value's share of its group's or the whole's total."""
    if by:
        return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))
    total = df.agg(F.sum(value).alias("_total"))  # one row
    return df.join(F.broadcast(total)).withColumn("share", F.col(value) / F.col("_total")).drop("_total")


def filled_matrix(counts: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """counts for every pair of the given row and column keys, 0 where there is none.  Both key tables are dimensions."""
    keys = rows.join(F.broadcast(columns))
    return keys.join(counts, rows.columns + columns.columns, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def overlaps(members: DataFrame, item: str, group: str) -> DataFrame:
    """(a, b, n): distinct items that two groups share, for pairs of groups a < b; groups are few, items are many."""
    distinct = members.select(item, group).distinct().groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g"))
    pairs = distinct.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def distinctive(counts: DataFrame, row: str, column: str, value: str, excess: float = 1.12) -> DataFrame:
    """counts with expected (row total * column total / total) and lift, where observed is above excess times expected."""
    total = counts.agg(F.sum(value).alias("_total"))  # one row
    by = lambda key: counts.groupBy(key).agg(F.sum(value).alias(f"_by_{key}"))
    full = counts.join(by(row), row).join(by(column), column).join(F.broadcast(total))
    full = full.withColumn("expected", F.col(f"_by_{row}") * F.col(f"_by_{column}") / F.col("_total")).select(*counts.columns, "expected")
    return full.withColumn("lift", F.col(value) / F.col("expected")).where(F.col(value) > excess * F.col("expected"))


def stratified(df: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """A sample of about n rows in which each group has its share, rounded up; picked by the order of key."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    quota = sizes.withColumn("quota", F.ceil(F.col("size") / F.sum("size").over(Window.partitionBy()) * n))
    return numbered(df, key, by=[group]).join(F.broadcast(quota), group).where(F.col("rn") <= F.col("quota"))


def paged(df: DataFrame, page: int, size: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)
