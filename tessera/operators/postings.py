"""Inverted indexes: postings, frequencies, concordances, boolean search.

Postings are rows (group, doc, term); arrays are made only for output.  Grouping by term shuffles after a
partial count; a capped list keeps row_number() <= cap, which Spark applies before its shuffle too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words


def term_rows(docs: DataFrame, doc: str, text: str, *more: str, tokens: Column | None = None) -> DataFrame:
    """(more..., doc, term): a row for each token of each document, repeats too."""
    return docs.select(*more, F.col(doc).alias("doc"), F.explode(words(text) if tokens is None else tokens).alias("term"))


def postings(docs: DataFrame, doc: str, text: str, *more: str, tokens: Column | None = None) -> DataFrame:
    """(more..., doc, term): a row for each distinct term of each document; no shuffle."""
    found = F.array_distinct(words(text) if tokens is None else tokens)
    return docs.select(*more, F.col(doc).alias("doc"), F.explode(found).alias("term"))


def term_frequency(rows: DataFrame, *group: str) -> DataFrame:
    return rows.groupBy(*group, "term").agg(F.count("*").alias("n"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def top_terms(counts: DataFrame, k: int, *group: str) -> DataFrame:
    """The k most frequent terms of each group, ties to the smaller term."""
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "term")
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def banded(counts: DataFrame, low: int = 3, high: int = 150) -> DataFrame:
    return counts.where(F.col("df").between(low, high))


def concordance(posted: DataFrame, cap: int = 2000) -> DataFrame:
    """(term, df, ids): the first cap documents of each term, as a text of ids."""
    order = Window.partitionBy("term").orderBy("doc")
    listed = posted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    lists = listed.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc")), lambda x: x.cast("string")), ",").alias("ids"))
    return document_frequency(posted).join(lists, "term")


def boolean_search(posted: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, hits, mode): documents with all terms; where none has all, those with any."""
    hits = posted.where(F.col("term").isin(terms)).groupBy("doc").agg(F.count("*").alias("hits"))
    most = hits.agg(F.max("hits").alias("most"))
    both = hits.join(F.broadcast(most))  # one row
    every = F.coalesce(F.col("most") == len(set(terms)), F.lit(False))
    return both.where(~every | (F.col("hits") == F.col("most"))).select("doc", "hits", F.when(every, "all").otherwise("any").alias("mode"))
