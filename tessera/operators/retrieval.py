"""Retrieval: exact vector search with filters, keyword search, hybrid order, evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import doubles, inner, norm, unit


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, inner(a, b) / n)


#: Queries that are held against one scan of the vectors; more go in blocks of so many.
QUERY_BLOCK = 4096
#: Queries and vectors whose scores are in memory at once.
TILE = (256, 2048)


def _unit_rows(vectors: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a length, and which those are."""
    x = np.asarray(vectors, np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    ok = (n > 0) & np.isfinite(n)
    return x[ok] / n[ok][:, None], ok


class _Best:
    """The k best of the vectors met so far, of each of some queries."""

    def __init__(self, q: np.ndarray, unit: np.ndarray, k: int, digits: int):
        order = np.argsort(q, kind="stable")
        self.q, self.unit, self.k, self.digits = q[order], unit[order], k, digits
        self.score, self.id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(ids), TILE[1]):
            for j in range(0, len(self.q), TILE[0]):
                self._tile(slice(j, j + TILE[0]), ids[i : i + TILE[1]], x[i : i + TILE[1]])

    def _tile(self, at: slice, ids: np.ndarray, x: np.ndarray) -> None:
        q, k = self.q[at], self.k
        scores = np.round(self.unit[at] @ x.T, self.digits)
        low, high = np.searchsorted(q, ids), np.searchsorted(q, ids, "right")
        for n in np.flatnonzero(high > low):
            scores[low[n] : high[n], n] = -np.inf  # a query doesn't find itself
        least = self.score[at, -1].copy()
        if len(ids) > k:
            new = ~np.isfinite(least)
            least[new] = np.maximum(least[new], np.partition(scores[new], len(ids) - k, axis=1)[:, len(ids) - k])
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        touched = np.unique(row)
        if not len(touched):
            return
        rows = np.concatenate([np.repeat(touched, k), row])
        found = np.concatenate([self.score[at][touched].ravel(), scores[row, col]])
        named = np.concatenate([self.id[at][touched].ravel(), ids[col]])
        order = np.lexsort((named, -found, rows))
        rows, found, named = rows[order], found[order], named[order]
        first = np.searchsorted(rows, touched)
        keep = first[:, None] + np.arange(k)[None, :]
        self.score[at.start + touched], self.id[at.start + touched] = found[keep], named[keep]

    def rows(self) -> list[np.ndarray]:
        some = np.isfinite(self.score)
        return [np.repeat(self.q, self.k).reshape(self.score.shape)[some], self.id[some], self.score[some]]


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(q, id, score, rn): each query's k best vectors by cosine, ties to the smaller id.  vectors (id, v), queries (q, qv).

    A stated query set against all rows: blocks of queries, of bounded size, are broadcast as unit vectors and multiplied
    with the vectors of one scan, tile by tile; of each query a task keeps its k best, and only those go on.  Null and zero
    vectors find nothing, nor do vectors of unlike length."""
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).where("qv IS NOT NULL").collect()
        asked = {}
        for dim in {len(r.qv) for r in rows}:
            own = [r for r in rows if len(r.qv) == dim]
            unit, ok = _unit_rows([r.qv for r in own])
            asked[dim] = np.array([r.q for r in own])[ok], unit
        shared = spark.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            best = {dim: _Best(q, unit, k, digits) for dim, (q, unit) in shared.value.items() if len(q)}
            for batch in batches:
                sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("v")), -1))
                for dim, own in best.items():
                    rows = batch.filter(pa.array(sizes == dim))
                    if rows.num_rows:
                        x, ok = _unit_rows(np.asarray(rows.column("v").flatten()).reshape(-1, dim))
                        own.meet(np.asarray(rows.column("id"))[ok], x)
            for own in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.rows()], ["q", "id", "score"])

        scored = vectors.select("id", "v").mapInArrow(run, "q long, id long, score double")
        best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k)
        out = best if out is None else out.union(best)
    return out


def stored_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, length, unit) as a table in the shared folder: vectors are normalised once, not at each search."""
    from tessera.operators.graph import stored

    return stored(df.select(key, norm(vector).alias("length"), unit(vector).alias("unit")), "vectors")


def fetched(vectors: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The vectors of the wanted keys."""
    return vectors.join(wanted.select(key).distinct(), key, "left_semi")


def vector_table(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), doubles(vector).alias("v"), *more)


def has_all(text: Column | str, terms: list[str]) -> Column:
    """Whether each term of more than two characters occurs in a text in lower case."""
    t = F.lower(text)
    out = F.lit(True)
    for x in terms:
        if len(x) > 2:
            out = out & F.contains(t, F.lit(x.lower()))
    return out


def keyword_first(keyword: DataFrame, vector: DataFrame, k: int, enough: int = 3) -> DataFrame:
    """(id, route, rn): keyword hits alone if there are enough, else they and then vector hits, each id once, k in all.
    keyword (id), vector (id, rn)."""
    some = keyword.orderBy("id").limit(k)
    n = some.agg(F.count("*").alias("n"))
    both = some.select("id", F.lit("keyword").alias("route"), F.lit(0).alias("o"), F.col("id").alias("p")).union(vector.select("id", F.lit("vector"), F.lit(1), F.col("rn").cast("long")))
    both = both.join(F.broadcast(n)).where((F.col("n") < enough) | (F.col("o") == 0))  # one row
    first = both.groupBy("id").agg(F.min(F.struct("o", "p", "route")).alias("m"))
    ranked = first.select("id", "m.route", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m.o", "m.p", "id")).alias("rn"))  # k keyword and k vector hits at most
    return ranked.where(F.col("rn") <= k)


def followed_up(turns: DataFrame, least: int = 7) -> DataFrame:
    """turns (conv, turn, role, text) of users with the query to search for: a turn of few words has the user's turn before it put in front."""
    users = turns.where(F.col("role") == "user")
    before = F.lag("text").over(Window.partitionBy("conv").orderBy("turn"))
    short = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")) < least
    return users.select("conv", "turn", F.when(short & before.isNotNull(), F.concat(before, F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("query"))


def routed(text: Column | str, foreign: str = "\\u00C0-\\u024F", share: float = 0.03, least: int = 2) -> Column:
    """Where a query goes: concordance for another script, keyword for some words, else vector."""
    from tessera.functions.text import script_share

    words = F.size(F.filter(F.split(text, "\\s+"), lambda w: F.length(w) > 2))
    return F.when(script_share(text, foreign) > share, "concordance").when(words >= least, "keyword").otherwise("vector")


def compared(found: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """One row comparing two models' results (q, model, rn, id, score): mean best score of each, queries that each wins,
    mean overlap of the first k."""
    own = found.where(F.col("rn") <= k).groupBy("q").agg(*[e for m in (a, b) for e in (
        F.max(F.when((F.col("model") == m) & (F.col("rn") == 1), F.col("score"))).alias(f"top_{m}"), F.collect_set(F.when(F.col("model") == m, F.col("id"))).alias(f"ids_{m}"))])
    return own.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(f"top_{a}"), 6).alias(f"avg_top_{a}"), F.round(F.avg(f"top_{b}"), 6).alias(f"avg_top_{b}"),
        F.count_if(F.col(f"top_{a}") > F.col(f"top_{b}")).alias(f"wins_{a}"), F.round(F.avg(F.size(F.array_intersect(f"ids_{a}", f"ids_{b}"))), 6).alias("overlap"),
    )
