"""Queries of the operators of this subpackage and of the pipeline; SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, html_text, language_id, near_text, packing, substrings, token_counts, toxicity, vector_dedup, vector_search


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_near_text": near_text.query,
        "op3_html_text": html_text.query,
        "op4_language_id": language_id.query,
        "op5_toxicity": toxicity.query,
        "op6_substrings": substrings.query,
        "op7_vector_search": vector_search.query,
        "op8_packing": packing.query,
        "op9_vector_dedup": vector_dedup.query,
        "op10_bpe": bpe.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_near_text": near_text.SQL, "op7_vector_search": vector_search.SQL, "op9_vector_dedup": vector_dedup.SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
