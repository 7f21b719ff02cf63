"""Queries against their SQL over small tables of odd rows."""

from __future__ import annotations

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import text as T
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import retrieval as V
from tests.oracle import same


def held(spark, tmp_path, query, name, rows, schema):
    """A query over one table, against its SQL."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(registry.queries()[query](spark, str(tmp_path)), con, registry.oracle_sql()[query])


def test_snippet_marks_words_beside_other_letters(spark, tmp_path):
    texts = ["Éles les leſx loś the2 ünd éthe. LOS", "", None, "leſ loſ_ und_ (und)", "x" * 139 + " les"]
    held(spark, tmp_path, "fn_snippet", "documents", [(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")


WORDS = ["Ab cd", "", None, "…Ab-cd ef,gh ij", "12 34", "x" * 700 + " b c d e f", "a b c d " + "y" * 700, "İx ΑΣ b", "a b c d e f " + "." * 600, "ab"]


def test_first_and_last_words_are_those_of_the_whole_text(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "t string")
    w = F.filter(F.split(F.lower("t"), "[^\\p{L}]+"), lambda x: x != "")
    for r in rows.select(F.slice(w, 1, 5), T.first_words("t", 5), F.get(w, F.size(w) - 1), T.last_word("t")).collect():
        assert r[0] == r[1] and r[2] == r[3]


def test_pairs_of_a_block_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    texts = ["ab cd ef gh x", "ab cd ef x", "ab cd", "ab cd ef gh y", "", None, "a|b cd ef"]
    rows = [(i, texts[i * i % 7], f"src{i % 3}" if i % 11 else None) for i in range(90)]
    held(spark, tmp_path, "er_dedup_two_layer", "documents", rows, "doc_id long, text string, source string")


def test_split_without_listed_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    rows = [(i, "ab cd ef gh" if i % 3 else "ab cd ef", f"src{i % 4}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(r.id1, r.id2) for r in registry.queries()["er_dedup_two_layer"](spark, str(tmp_path)).collect()]
    years = [(i, i % 13 + 100 if i % 5 else None) for i in range(120)]
    partners = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i, _ in years}
    clusters = []  # the rule as it reads, over one component
    for i, y in years:
        if y is not None:
            fits = next((c for c in clusters if all(abs(y - years[j][1]) <= 5 for j in c)), None)
            clusters.append({i}) if fits is None else fits.add(i)
    for i, y in years:
        counts = [len(partners[i] & c) for c in clusters]
        if y is None and max(counts):
            clusters[counts.index(max(counts))].add(i)
    want = sorted((i, min(c)) for c in clusters if len(c) > 1 for i in c)
    got = registry.queries()["er_conflict_split"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.cluster) for r in got) == want
    assert sorted((i, min(c)) for c in E.split_members(years, pairs) for i in c) == want


def test_thinned_edges_connect_the_same(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(900)] + [(i, i + 1) for i in range(400, 440)], "a long, b long")
    thin = G.thinned(edges.repartition(3), held=50)
    assert thin.count() < 3 * 341
    assert sorted(map(tuple, G.components(thin).collect())) == sorted(map(tuple, G.components(edges).collect()))


def test_merge_of_null_and_ambiguous_names(spark):
    known = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "id long, name string")
    entries = spark.createDataFrame([(10, "a b c f", 0), (11, "a b c f g", None), (12, None, 1), (13, "a b c d z", 2)], "entry_id long, name string, prio int")
    got = {r.entry_id: (r.id, r.method) for r in E.source_merge(entries, known).collect()}
    assert got == {10: (-10, "new"), 11: (-10, "prefix4"), 12: (-12, "new"), 13: (1, "prefix4")}


def test_blocking_counts_pairs_without_listing_them(spark, tmp_path):
    rng = random.Random(8)
    texts = ["a b c" + "x" * rng.randrange(500) for _ in range(150)] + ["a b c" + "x" * 40] * 20 + ["a b", "a b ", "", "", None, None, "q  r s", "q  r t"]
    rng.shuffle(texts)
    held(spark, tmp_path, "er_blocking_pairs", "documents", [(7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plan = registry.queries()["er_blocking_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert " = block" not in plan and "id1" not in plan


def test_vector_scores_are_held_by_tiles(spark, monkeypatch):
    seen = []

    class Noted(V._Best):
        def _tile(self, at, ids, x):
            seen.append(len(self.q[at]) * len(ids))
            super()._tile(at, ids, x)

    monkeypatch.setattr(V, "TILE", (3, 5))
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (40, 3)).astype(float)
    q = np.arange(0, 40, 4)
    ok = (x != 0).any(axis=1)
    best = Noted(q[ok[q]], V._unit_rows(x[q])[0], 4, 6)
    ids = rng.permutation(np.flatnonzero(ok))
    for part in (ids[:13], ids[13:14], ids[14:]):
        best.meet(part, V._unit_rows(x[part])[0])
    unit = x / np.where(ok, np.sqrt((x * x).sum(axis=1)), 1)[:, None]
    want = [(i, *r) for i in q if ok[i] for r in sorted(((-round(float(unit[i] @ unit[j]), 6), j) for j in ids if j != i))[:4]]
    got = sorted(zip(*[c.tolist() for c in best.rows()], strict=True))
    assert [(a, b) for a, b, _ in got] == sorted((a, j) for a, _, j in want)
    assert max(seen) <= 15
