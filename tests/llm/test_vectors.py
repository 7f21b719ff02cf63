from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_dedup as VD
from tessera.llm import vector_search as VS
from tests.conftest import DATA
from tests.oracle import connected, same

SF = f"{DATA}/sf0.001"


def naive_top(rows, k=5):
    out = []
    for i, q in rows:
        if i % 50 == 0:
            s = sorted(((-int(np.floor(256 * q) @ np.floor(256 * v)), j) for j, v in rows if j != i))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 10), dim))
    x = base[rng.integers(0, len(base), n)] + 0.4 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(VS, "CANDIDATE_ROWS", 150)
        monkeypatch.setattr(VS, "QUERY_ROWS", 4)
        monkeypatch.setattr(VS, "RUN", 7)
    x = clustered(700)
    rows = [(i, v) for i, v in enumerate(x)]
    df = VS.usable(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, e array<double>"), "vec_id", "e")
    got = VS.search(df, df.where("id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == naive_top(rows)


def test_elimination_stops_early():
    x = VS.quantised(clustered(3000))
    p = np.vstack([np.zeros((1, 16)), VS.pivots_of(x[:500])])
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            seen.append(len(i) if hasattr(i, "__len__") else 1)
            return np.asarray(self)[i]

    VS.top_k(np.array([0]), x[:1], VS.distances(x[:1], p), np.arange(3000), x.view(Counted), VS.distances(x, p), 5)
    assert sum(seen) < 3000


def test_search_query_equals_duckdb(spark):
    same(VS.query(spark, SF), connected(SF), VS.SQL)


def test_search_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.5, 0.5]), (6, [1.0, 2.0, 3.0]), (7, [])]
    df = VS.usable(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted(map(tuple, VS.search(df, df.where("id % 50 = 0")).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 32768), (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 2, 32768)]
    assert VS.search(df.limit(0), df.limit(0)).count() == 0


def naive_links(rows, t=0.93):
    ids = [r[0] for r in rows]
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, lab) in enumerate(rows):
        for j, w, other in rows[:a]:
            if lab == other and float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)) >= t:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [VD.BLOCK, 20])
def test_dedup_links(spark, monkeypatch, block):
    monkeypatch.setattr(VD, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = clustered(300, 32, 4)
    x = np.vstack([x, x[:60] + 0.03 * rng.standard_normal((60, 32)), np.tile(x[0], (70, 1)) + 0.02 * rng.standard_normal((70, 32)), x[:5]])
    rows = [(i, v, int(i % 3 == 0)) for i, v in enumerate(x)]
    rows = [(i, v, 1) if i >= 360 else (i, v, lab) for i, v, lab in rows]
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in VD.near_duplicates(df).collect()}
    want = naive_links(rows)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_recall_at_the_threshold():
    """Pairs at just the threshold share a bucket as often as is asked for."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    k, tables = VD.shape(50_000)
    label = np.zeros(4000, np.int64)
    met = (VD.buckets(a, label, k, tables) == VD.buckets(b, label, k, tables)).any(axis=1)
    assert met.mean() >= 0.97
    far = (VD.buckets(a, label, k, tables) == VD.buckets(a[::-1].copy(), label, k, tables)).mean()
    assert far < 1e-3


def test_dedup_query_equals_duckdb(spark):
    same(VD.query(spark, SF), connected(SF), VD.SQL)


def test_dedup_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], 2), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in VD.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11)) and len(got) == 12
    assert VD.near_duplicates(df.limit(0)).count() == 0


def test_large_components_are_exact_and_stay_in_64_bits(spark):
    big = [[1e12, -3e11, 5.0], [9e11, 4e11, -7.0], [1.0, 2.0, 3.0], [-1e300, 1e300, 1e308], [1e307, -1e307, 1e307]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    v = VS.usable(df, "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in VS.search(v, v, k=2).collect())
    whole = [[int(x) for x in VS.quantised(np.array(row)).tolist()] for row in big]
    want = []
    for i, q in enumerate(whole):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j) for j, c in enumerate(whole) if j != i)
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:2], 1)]
    assert got == sorted(want)


def test_tiny_and_huge_vectors_link_by_their_angle(spark):
    rows = [(0, [1e-200, 0.0], 1), (1, [0.0, 1e-200], 1), (2, [3e-200, 1e-203], 1), (3, [1e200, 0.0], 1), (4, [1e308, 1e308], 1), (5, [2.0, 2.0], 1), (6, [5e-324, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in VD.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (0, 1), 2: (3, 0), 3: (3, 0), 6: (3, 0), 4: (1, 4), 5: (1, 4)}
