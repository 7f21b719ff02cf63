"""Operator 9: near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors at a cosine of THRESHOLD lie sqrt(2 - 2 THRESHOLD) apart.  Each of several tables has
hashes floor((a.x + b) / width) with Gaussian a; a bucket is a label, a table and its hashes.  Hashes per
table follow from the number of vectors, tables from the recall wanted at the threshold (closer pairs are
found more surely).  Buckets with one vector end there; others are dealt out in blocks, of which every two
of a bucket meet in a task of bounded size, and each pair is checked exactly.  A pair counts in the first
table whose bucket it shares, so link counts need no list of pairs (the buckets in earlier tables are computed anew for the
vectors of found links alone, so that no row carries them); links within a task go on as a
spanning forest, and components are found over those.  Before anything is computed, vectors are scaled by a power of 2 that
brings their greatest component near 1, so that norms neither vanish nor overflow.

Equal vectors of one label are one class with a weight, before anything is compared.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or non-finite
components, link with nothing, and so do rows without an id.  Vectors of unlike length don't link.  Repeated
rows of one id are one row of the result, each of another id links with both.  Extra columns aren't read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import M1, mixed, written
from tessera.llm.graphs import Forest, components
from tessera.llm.vector_search import matrix

THRESHOLD = 0.93
#: Chance at least that a pair at the threshold shares a bucket; measured against brute force in the tests.
RECALL = 0.985
#: Width of a hash's step, in units of the length of the vectors.
WIDTH = 1.5
#: Vectors of a block.
BLOCK = 1024
SEED = 11


def chance(distance: float, width: float) -> float:
    """Chance that one p-stable hash is equal for two points at a distance."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Hashes per table, so that an unrelated pair shares a bucket in one of n cases at most, and tables."""
    k = max(1, math.ceil(math.log(max(2, n)) / -math.log(chance(math.sqrt(2), width))))
    p = chance(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


@cache
def projections(dim: int, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, k])
    return rng.standard_normal((tables * k, dim)), rng.uniform(0, width, tables * k)


def buckets(x: np.ndarray, label: np.ndarray, k: int, tables: int, width: float = WIDTH, first: int | None = None) -> np.ndarray:
    """64-bit bucket of each vector in each table (rows x tables), or in the first ones alone."""
    a, b = projections(x.shape[1], k, tables, width)
    tables = tables if first is None else first
    a, b = a[: tables * k], b[: tables * k]
    # sums in a fixed order, whatever the rows beside: a vector has the same buckets in every task
    h = np.floor((np.einsum("ij,kj->ik", x, a) + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    out = mixed(label.astype(np.int64).view(np.uint64) + np.uint64(x.shape[1] * 1000003))[:, None] ^ mixed(np.arange(1, tables + 1, dtype=np.uint64))[None, :]
    for j in range(k):
        out = mixed(out * M1 + h[:, :, j])
    return out.view(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of 2 that brings their greatest component to between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _linked(x: np.ndarray, weight: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, threshold: float, k: int, tables: int) -> tuple[np.ndarray, Forest]:
    """Weights linked to each vector by pairs of left and right that first meet in this table; their forest."""
    degree, forest = np.zeros(len(x), np.int64), Forest(len(x))
    x = scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    keys, known = np.zeros((len(x), table), np.int64), np.zeros(len(x), bool)  # buckets in the tables before
    same = len(left) == len(right) and bool((left == right).all())
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        ok = (x[rows] @ x[right].T) >= threshold * norm[rows][:, None] * norm[right][None, :]
        if same:
            ok &= rows[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        i, j = rows[i], right[j]
        if table and len(i):
            new = np.unique(np.concatenate([i, j]))
            new = new[~known[new]]
            if len(new):
                keys[new] = buckets(x[new] / norm[new][:, None], np.zeros(len(new), np.int64), k, tables, first=table)
                known[new] = True
        for c in range(0, len(i), 1 << 16):
            u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            if table:
                first = ~(keys[u] == keys[v]).any(axis=1)
                u, v = u[first], v[first]
            np.add.at(degree, u, weight[v])
            np.add.at(degree, v, weight[u])
            for s, t in zip(u.tolist(), v.tolist(), strict=True):
                forest.join(s, t)
    return degree, forest


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each id."""
    all_ids = vectors.select(F.col(key).cast("long").alias("vec_id")).distinct()
    v = F.col(column).cast("array<double>")
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    good = good.withColumn("v", F.transform("v", lambda x: x + 0.0))  # -0 and 0 are one
    members = written(good.distinct().withColumn("h", F.xxhash64("label", "v")), "vectors")
    classes = members.groupBy("label", "v", "h").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    classes = written(classes.withColumn("dim", F.size("v")), "classes")
    k, tables = shape(classes.count(), threshold)

    def signed(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                keys = buckets(unit_rows(matrix(part.column("v"), dim)), np.asarray(part.column("label")), k, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "keys"])

    signatures = written(classes.select("id", "label", "v", "dim").mapInArrow(signed, "id long, keys array<long>"), "signatures")
    met = signatures.select("id", F.posexplode("keys").alias("t", "bucket"))
    shared = met.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    salted = met.join(shared, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # every two blocks of a bucket meet once: block i goes to (i, j) for j >= i and to (j, i) for j < i
    dealt = salted.select("t", "bucket", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    full = dealt.join(classes.select("id", "v", "weight", "dim"), "id")

    def checked(key_, table):
        t, i, j = key_[0].as_py(), key_[2].as_py(), key_[3].as_py()
        ids, own = np.asarray(table["id"]), np.asarray(table["own"])
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], own[order]
        x = matrix(table["v"], table["dim"][0].as_py())[order]
        weight = np.asarray(table["weight"])[order]
        degree, forest = _linked(x, weight, t, np.flatnonzero(own == i), np.flatnonzero(own == j), threshold, k, tables)
        hit = np.flatnonzero(degree)
        return pa.table({"id": ids[hit], "n": degree[hit], "root": ids[np.array([forest.find(int(h)) for h in hit], np.int64)] if len(hit) else ids[hit]})

    found = written(full.groupBy("t", "bucket", "i", "j").applyInArrow(checked, "id long, n long, root long"), "links")
    degrees = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-links")
    per_class = classes.select("h", "label", "v", "id", "weight").join(degrees, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    per_class = per_class.select("h", "label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    own = members.join(per_class, ["h", "label", "v"]).groupBy("id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = all_ids.join(own, all_ids["vec_id"] == own["id"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: What DuckDB finds by comparing all pairs and closing the links.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id) LEFT JOIN d ON d.a = e.vec_id
"""
