"""CSV with list columns, word-processor files, paged REST sources."""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.request
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def csv(spark: SparkSession, path: str, schema: str, lists: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; list columns hold literals of a list, empty where they can't be read."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    for c, kind in (lists or {}).items():
        df = df.withColumn(c, literal_list(c, kind))
    return df


def literal_list(text: Column | str, kind: str = "long") -> Column:
    """['a', 'b'] or [1, 2] as an array; an empty one if it isn't well formed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.from_json(F.translate(c, "'", '"'), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a word-processor file; none if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return ["".join(t.text or "" for t in p.iter(f"{_TEXT}t")) for p in tree.iter(f"{_TEXT}p")]


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, line): a row for each paragraph of each file."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(docx_paragraphs(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "i", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, line string")


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """A REST collection read page by page: each page is a partition.

    Options: url with {page} in it, pages (how many), retries, field (the key of the list of records).  A page is
    asked for again after an error or a 429 with a doubling pause."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.pages = options["url"], int(options.get("pages", 1))
        self.retries, self.field = int(options.get("retries", 3)), options.get("field", "data")

    def partitions(self):
        return [Page(i) for i in range(1, self.pages + 1)]

    def read(self, partition):
        for record in fetched(self.url.format(page=partition.number), self.retries).get(self.field, []):
            yield partition.number, json.dumps(record, ensure_ascii=False)


def fetched(url: str, retries: int = 3, pause: float = 1.0) -> dict:
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return json.load(r)
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    return {}


def paged(spark: SparkSession, url: str, pages: int, field: str = "data", retries: int = 3) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(url=url, pages=pages, field=field, retries=retries).load()
