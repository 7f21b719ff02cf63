"""Documents, chapter indexes, grades, word lists and verses from JSON folders of the form book/chapter.json.

Schemas are declared; a file that isn't JSON (a saved error page) gives no document.  Fields that hold one of several types
are read as text and decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the files.
DOCUMENT = "id long, idInBook long, arabic string, english string, grade string, majlisiGrading string, behdudiGrading string, mohseniGrading string, chapter string, url string"
VERSE = "array<struct<k: string, a: int, words: array<struct<t: string, r: string>>>>"
ROOT = "struct<b: string, m: string, f: long, v: array<string>, fam: string>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(book, file, value): each JSON file whole."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    parts = F.split("path", "/")
    return raw.select(F.url_decode(F.element_at(parts, -2)).alias("book"), F.url_decode(F.element_at(parts, -1)).alias("file"), "value")


def chapters(spark: SparkSession, root: str) -> DataFrame:
    """(book, ch_idx, file, name_ar, name_en, cnt): a book's index in its order."""
    rows = _files(spark, f"{root}/*/index.json").select("book", F.posexplode(F.from_json("value", "array<struct<file: string, name_ar: string, name_en: string, count: long>>")).alias("ch_idx", "c"))
    return rows.select("book", "ch_idx", "c.file", "c.name_ar", "c.name_en", F.col("c.count").alias("cnt"))


def english(raw: Column | str) -> tuple[Column, Column]:
    """Narrator and text of a field that is a text or a struct of both."""
    c = F.col(raw) if isinstance(raw, str) else raw
    both = F.from_json(c, "narrator string, text string")
    held = c.startswith("{")
    return F.when(held, F.coalesce(both["narrator"], F.lit(""))).otherwise(F.lit("")), F.when(held, F.coalesce(both["text"], F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(book, ch_idx, ord, doc_id, arabic, narrator, english, grade): all documents of the chapters that the indexes list."""
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in DOCUMENT.split(", "))
    rows = _files(spark, f"{root}/*/[0-9]*.json").select("book", "file", F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("ord", "d"))
    listed = chapters(spark, root).select("book", "ch_idx", "file")
    narrator, text = english("d.english")
    grade = F.coalesce(*[F.nullif(F.trim(f"d.{g}"), F.lit("")) for g in ("grade", "majlisiGrading", "behdudiGrading", "mohseniGrading")])
    return rows.join(listed, ["book", "file"]).select("book", "ch_idx", "ord", F.coalesce("d.idInBook", "d.id").alias("doc_id"), F.col("d.arabic").alias("arabic"), narrator.alias("narrator"), text.alias("english"), grade.alias("grade"))


def key_values(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(key, value) of JSON files that are one map; a value of another kind is null, keys with a leading underscore are comments."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("key", "value"))
    return rows.where(~F.col("key").startswith("_"))


def grades(spark: SparkSession, root: str) -> DataFrame:
    """(book, doc_id, grade) of the grade files beside the chapters."""
    rows = _files(spark, f"{root}/*/grades.json").select("book", F.explode(F.from_json("value", "map<string, string>")).alias("id", "grade"))
    return rows.select("book", F.col("id").try_cast("long").alias("doc_id"), "grade")


def with_grades(docs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """docs with an empty grade filled from the grade files."""
    own = sidecar.withColumnRenamed("grade", "other")
    return docs.join(own, ["book", "doc_id"], "left").withColumn("grade", F.coalesce("grade", "other")).drop("other")


def verses(spark: SparkSession, path: str) -> DataFrame:
    """(verse, number, pos, word, root): the words of verse files; words without a root have none."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", VERSE)).alias("v"))
    return rows.select(F.col("v.k").alias("verse"), F.col("v.a").alias("number"), F.posexplode("v.words").alias("pos", "w")).select("verse", "number", "pos", F.col("w.t").alias("word"), F.col("w.r").alias("root"))


def roots(spark: SparkSession, path: str) -> DataFrame:
    """(root, b, m, f, v, fam): a root index; fam is a list, be it one text, a list or missing."""
    rows = key_values(spark, path, ROOT)
    fam = F.col("value.fam")
    families = F.when(fam.isNull(), F.array().cast("array<string>")).when(fam.startswith("["), F.from_json(fam, "array<string>")).otherwise(F.array(fam))
    return rows.select(F.col("key").alias("root"), "value.b", "value.m", "value.f", F.array_distinct("value.v").alias("v"), families.alias("fam"))


def commentary(spark: SparkSession, path: str) -> DataFrame:
    """(verse, text): comments on verses; a verse that names another has that one's text, or none if it's missing."""
    rows = key_values(spark, path)
    own = F.when(F.col("value").startswith("{"), F.from_json("value", "text string")["text"])
    at = rows.select(F.col("key").alias("verse"), own.alias("text"), F.when(~F.col("value").startswith("{"), F.regexp_replace("value", '^"|"$', "")).alias("alias"))
    other = at.select(F.col("verse").alias("alias"), F.col("text").alias("other"))
    return at.join(other, "alias", "left").select("verse", F.coalesce("text", "other").alias("text"))
