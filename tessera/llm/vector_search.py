"""Operator 7: exact top-k search by pivot-table elimination.

Vectors are turned into integers floor(256 x).  Distances of every vector to PIVOTS pivots are computed
once; for a query the greatest difference of such distances bounds the distance to a candidate from below,
and with the vectors' lengths their inner product from above.  Candidates are evaluated in the order of
that bound, a run at a time, until the k-th best score exceeds the next bound: the result is exact.

Queries and candidates meet in blocks of rows: every query block meets every candidate block in
a task of bounded size, which gives k rows a query; a window merges them.

Defined results: scores tie to the smaller id; a query doesn't find its own row; with fewer than k other
rows all are returned.  Scores whose sums may pass 2**53 are added up as whole numbers of any size, without elimination; one that
leaves 64 bits counts as the nearest that doesn't.  Vectors that are null, empty or hold null or non-finite components take no part,
nor do rows without an id; vectors of unlike length don't meet.  Of repeated rows of one id each takes part as
a candidate; equal rows count as one query, unlike rows of one id share one list.  Extra columns aren't read.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries.
CANDIDATE_ROWS = 8192
QUERY_ROWS = 2048
#: Pivots: vectors far from each other, of a sample of so many rows, for so many lengths of vectors; the origin is one more.
PIVOTS = 32
PIVOT_ROWS = 1000
PIVOT_DIMS = 4
#: Candidates evaluated at a time.
RUN = 256


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, dim) with v array<double>, of rows that take part."""
    v = F.col(column).cast("array<double>")
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.col("dim") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(-1, dim) if dim else np.zeros((len(col), 0))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x): whole numbers, held as doubles whose products and sums are exact below 2**53."""
    most = np.finfo(np.float64).max
    return np.clip(np.floor(256.0 * np.clip(x, -most / 256, most / 256)), -most, most)


def pivots_of(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n rows of x, each farthest from those before it; ties to the earlier row."""
    if not len(x):
        return x
    picked = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)):
        i = int(far.argmax())
        if far[i] == 0:
            break
        picked.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(axis=1))
    return x[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):  # of vectors too large for it; their bounds aren't used
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T))


def top_k(qid: np.ndarray, q: np.ndarray, q_table: np.ndarray, cid: np.ndarray, c: np.ndarray, table: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best candidates of this block; table, q_table: distances to the pivots."""
    largest = [float(np.abs(x).max(initial=0)) for x in (q, c)]
    if largest[0] * largest[1] * max(1, q.shape[1]) >= 2**53:
        return _plain_top_k(qid, q, cid, c, k)
    cc, qq = (c * c).sum(axis=1), (q * q).sum(axis=1)
    out = []
    for i in range(len(q)):
        low = np.abs(table - q_table[i]).max(axis=1)
        low = np.maximum(0.0, low - 1e-6 * (1 + low))  # what rounding could have added
        bound = np.floor((qq[i] + cc - low * low) / 2 + 1e-6)
        order = np.lexsort((cid, -bound))
        order = order[cid[order] != qid[i]]
        best_s, best_v = np.zeros(0), np.zeros(0, np.int64)
        for a in range(0, len(order), RUN):
            run = order[a : a + RUN]
            if len(best_s) == k and bound[run[0]] < best_s[-1]:
                break
            best_s, best_v = np.concatenate([best_s, c[run] @ q[i]]), np.concatenate([best_v, cid[run]])
            first = np.lexsort((best_v, -best_s))[:k]
            best_s, best_v = best_s[first], best_v[first]
        out += [(int(qid[i]), int(v), int(s)) for v, s in zip(best_v, best_s, strict=True)]
    return out


def _plain_top_k(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """top_k by all scores, in whole numbers of any size."""
    candidates = [[int(x) for x in row] for row in c.tolist()]
    out = []
    for i in range(len(q)):
        own = [int(x) for x in q[i].tolist()]
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(map(operator.mul, own, row)))), int(v)) for v, row in zip(cid, candidates, strict=True) if v != qid[i]]
        out += [(int(qid[i]), v, -s) for s, v in heapq.nsmallest(k, scores)]
    return out


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with v quantised and d, the distances to the pivots of their length and to the origin."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = quantised(matrix(part.column("v"), dim))
                d = distances(x, np.vstack([np.zeros((1, dim)), shared.value.get(dim, np.zeros((0, dim)))]))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())) for y in (x, d)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists, part.column("dim")], ["id", "v", "d", "dim"])

    return vectors.select("id", "v", "dim").mapInArrow(run, "id long, v array<double>, d array<double>, dim int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors and queries of (id, v, dim)."""
    n, nq = vectors.count(), queries.count()
    # pivots come from a bounded sample; any pivots give right bounds
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 2 * PIVOT_ROWS / max(1, n)))).orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).collect()
    pivots = {dim: pivots_of(quantised(np.array([r.v for r in some if r.dim == dim]))) for dim in sorted({r.dim for r in some})[:PIVOT_DIMS]}
    blocks, q_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-nq // QUERY_ROWS))
    # a block is a hash of id and vector, so that a hot id or vector doesn't gather rows; each meets all blocks of the other side
    met = lambda own, b, other, o: (F.pmod(F.xxhash64("id", "v"), F.lit(b)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(o - 1))).alias(other))
    c = pivot_table(vectors, pivots).select(*met("block", blocks, "part", q_blocks), F.lit(False).alias("query"), "id", "v", "d", "dim")
    q = pivot_table(queries.distinct(), pivots).select(*met("part", q_blocks, "block", blocks), F.lit(True).alias("query"), "id", "v", "d", "dim")

    def run(key, table):
        dim = key[2].as_py()
        is_q, ids, x = np.asarray(table["query"]), np.asarray(table["id"]), matrix(table["v"], dim)
        d = matrix(table["d"], len(table["d"][0]))
        found = top_k(ids[is_q], x[is_q], d[is_q], ids[~is_q], x[~is_q], d[~is_q], k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.int64())})

    best = c.unionByName(q).groupBy("block", "part", "dim").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % 50 == 0))


#: What DuckDB finds by comparing all pairs.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
