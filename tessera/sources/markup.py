"""Marked-up texts: continuation lines, records, headings, graded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cleaned(text: str | Column) -> Column:
    """Text without metadata lines, page and manuscript marks, and with continuation lines joined."""
    out = F.regexp_replace(text, "(?m)^(?:#META#|######).*\\n?", "")
    out = F.regexp_replace(out, "\\n~~", " ")
    return F.regexp_replace(out, "PageV\\d+P\\d+|ms\\d+", "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), cleaned("value").alias("text"))


def lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return texts.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))


def records(rows: DataFrame, key: str, order: str, begins: Column) -> DataFrame:
    """rows with record: how many beginnings came up to each; rows before the first are left out."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("record", F.sum(F.when(begins, 1).otherwise(0)).over(running)).where(F.col("record") > 0)


def entries(text: str | Column, begin: str) -> Column:
    """Texts between one beginning and the next; group 1 of begin is the number, if it has one."""
    return F.filter(F.split(text, f"(?m)(?=^(?:{begin}))"), lambda x: x.rlike(f"^(?:{begin})"))


def headed(rows: DataFrame, key: str = "path", least: int = 20) -> DataFrame:
    """(volume, chapter, section, number, text): numbered records of lines under headings of three levels,
    renumbered within their chapter; records shorter than least characters are dropped."""
    order = Window.partitionBy(key).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    level = lambda marks: F.nullif(F.trim(F.regexp_extract("line", f"^### {marks} ([^|].*)$", 1)), F.lit(""))
    at = rows.select(key, "i", "line", level("\\|").alias("v"), level("\\|\\|").alias("c"), level("\\|\\|\\|").alias("s"), F.regexp_extract("line", "^# (\\d+) - (.*)$", 1).try_cast("long").alias("n"), F.regexp_extract("line", "^# (\\d+) - (.*)$", 2).alias("first"))
    filled = at.select(key, "i", "line", "n", "first", *[F.last(x, ignorenulls=True).over(upto).alias(y) for x, y in (("v", "volume"), ("c", "chapter"), ("s", "section"))], F.last("n", ignorenulls=True).over(upto).alias("number"), F.count("n").over(upto).alias("record"))
    body = filled.where((F.col("record") > 0) & ~F.col("line").startswith("###"))
    parts = body.groupBy(key, "record").agg(
        F.min_by("volume", "i").alias("volume"), F.min_by("chapter", "i").alias("chapter"), F.min_by("section", "i").alias("section"), F.min("i").alias("i"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("n").isNotNull(), F.col("first")).otherwise(F.col("line")).alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    kept = parts.withColumn("text", F.trim("text")).where(F.length("text") >= least)
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(key, "volume", "chapter").orderBy("i"))).drop("record", "i")


def graded(rows: DataFrame, key: str, order: str, number: Column, grade: Column) -> DataFrame:
    """(key, number, grade): each number's first grade line; grade lines before any number are dropped."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = rows.select(key, order, F.last(number, ignorenulls=True).over(upto).alias("number"), grade.alias("grade"))
    return at.where(F.col("number").isNotNull() & F.col("grade").isNotNull()).groupBy(key, "number").agg(F.min_by("grade", order).alias("grade"))


def repaired(text: str | Column, table: dict[str, str]) -> Column:
    """Text with recognition errors replaced, in the table's order."""
    out = F.col(text) if isinstance(text, str) else text
    for wrong, right in table.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out
