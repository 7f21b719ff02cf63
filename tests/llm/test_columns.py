"""Extra columns, with the names that operators use themselves, neither break nor get lost."""

from __future__ import annotations

import pytest

from tessera.llm import bpe, language_id, near_text, packing, substrings, token_counts, toxicity
from tessera.llm.bpe import tokenizer_path

CLASHING = ("id", "k", "h", "n", "y", "f", "i", "lang", "digest", "prefix", "token", "tile", "part", "block", "first", "component", "row", "piece", "start", "spans", "score", "predicted", "lang_pred", "n_tokens", "decoded", "ids", "_id", "repeats", "members", "rep")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the small text number {i % 3} of the table", *(f"{c}{i}" for c in CLASHING)) for i in range(6)] + [(None, None, *([None] * len(CLASHING)))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHING)]))


def test_text_operators(spark, docs):
    pieces = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    model = language_id.fitted(docs)
    toxic = toxicity.fitted(docs, spark.createDataFrame([(1, 1, "z"), (2, 0, "z")], "doc_id long, toxic int, text string"))
    for out, made in (
        (token_counts.token_counts(docs, pieces), {"n_tokens"}), (bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json")), {"ids", "n_tokens", "decoded"}), (language_id.identify(docs, model), {"lang_pred", "score"}),
        (toxicity.score(docs, toxic), {"score", "predicted"}), (substrings.deduplicated(docs, least=1), {"n_chunks", "n_cut", "words_cut", "spans"}),
    ):
        rows = out.collect()
        assert len(rows) == 7 and len(set(out.columns)) == len(out.columns)
        kept = [c for c in CLASHING if c not in made]
        assert {tuple(r[c] for c in kept) for r in rows} == {tuple(r[c] for c in kept) for r in docs.collect()}


def test_grouping_operators(docs):
    got = {r.doc_id: r.component_id for r in near_text.near_copies(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2, None: None}
    sized = docs.selectExpr("*", "length(text) AS len")
    assert packing.packed(sized, length="len").count() == 6
