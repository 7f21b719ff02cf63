"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, near_text, packing, substrings, toxicity
from tessera.llm.common import written

STAGES = [
    ("toxicity", toxicity.stage),
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", near_text.stage),
    ("substring dedup", substrings.stage),
    ("best-fit packing", packing.stage),
]

#: SQL can't express these stages; tests/llm holds run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
