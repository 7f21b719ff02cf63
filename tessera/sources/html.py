"""Fields of web pages by patterns and containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(html: str | Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that occurs; the empty text if none does."""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def plain(html: str | Column) -> Column:
    """HTML without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>", ""), "<[^>]*>", "")


def cells(html: str | Column, tag: str = "td") -> Column:
    """Contents of all elements of a tag, without the markup in them."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def second_cell(html: str | Column) -> Column:
    """The second table cell without a suffix in parentheses; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.get(cells(html), F.lit(1)), "\\([^)]*\\)", "")), F.lit(""))


def containers(pages: DataFrame, column: str, marker: str) -> DataFrame:
    """A row (pos, part) for what follows each marker of each page; text before the first is left out."""
    return pages.select("*", F.posexplode(F.split(column, marker)).alias("pos", "part")).where(F.col("pos") > 0)


def css_text(html: str | Column, name: str) -> Column:
    """Text of the first element that has a class."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, f"(?is)<(\\w+)[^>]*class=\"[^\"]*\\b{name}\\b[^\"]*\"[^>]*>(.*?)</\\1>", 2), "<[^>]*>", ""))
