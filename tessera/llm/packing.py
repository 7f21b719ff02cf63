"""Operator 8: packing documents into training sequences of several permitted lengths, best fit.

Documents longer than the greatest permitted length are cut into pieces of that length and a rest.  Pieces
are dealt by hash into shards of about SHARD pieces, each packed alone and in order of falling length:

* a piece goes to the open bin with the least room that holds it (ties: the bin opened first);
* else a bin opens with the permitted length of least cost a token: a bin of capacity c costs
  c + OVERHEAD, shared by the tokens it is expected to hold: the piece and what the shard's shorter pieces can
  fill of the rest, from the tokens of pieces that fit there;
* at the end each bin shrinks to the least permitted length that holds its contents.

A shard's bins number from 0, so (shard, bin) names a bin.  Shards are bounded; no row is left out.
Rows of equal id and length are counted and numbered by that count, so that the result depends on the rows alone, not on
their order or partitions, and a hot id isn't gathered.

Defined results: a null or empty text, or one of 0 tokens, makes no piece and gives no row.  Ties of length go
to the smaller id (null first), then piece, then the shorter text, then number of the repetition.  Repeated rows are pieces of their own; a null id is
packed like any other.  A text of any length is packed whole.  Extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import tokenizer_path
from tessera.llm.common import written
from tessera.llm.token_counts import token_counts, vocabulary

#: Permitted sequence lengths, in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length.
OVERHEAD = 32
#: Pieces of a shard.
SHARD = 20_000
#: Rows of equal id and length, or pieces of a text, that one row is unfolded to at a time.
UNFOLDED = 1_000


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's final capacity; lengths fall, none above the greatest permitted."""
    below = np.concatenate([[0], np.cumsum(lengths[::-1])])  # tokens of the i shortest pieces
    rising = lengths[::-1]
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    where, offset, used = [], [], []
    for i, length in enumerate(lengths):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            rest, best = len(lengths) - i - 1, None
            for c in permitted:
                if c >= length:
                    fits = min(rest, bisect_left(rising, c - length + 1))
                    cost = (c + overhead) / (length + min(c - length, int(below[fits])))
                    if best is None or cost < best[0]:
                        best = cost, c
            room, b = best[1], len(used)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += length
        if room > length:
            insort(rooms, (room - length, b))
    return where, offset, [permitted[bisect_left(permitted, u)] for u in used]


def packed(docs: DataFrame, key: str = "doc_id", length: str = "n_tokens", permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin, offset, capacity): where the tokens from start on of each document go."""
    permitted = tuple(sorted(permitted))
    most = permitted[-1]
    n = F.col(length).cast("long")
    rows = docs.where(n > 0).select(F.col(key).cast("long").alias("doc_id"), n.alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("times"))
    rows = written(rows, "lengths")
    whole = F.ceil(F.col("n") / most)
    pieces = rows.agg(F.sum(F.col("times") * whole)).first()[0] or 0
    shards = max(1, -(-pieces // shard))

    def unfolded(df: DataFrame, many, name: str) -> DataFrame:
        """A row for each number below many, in two steps, so that a row of many is dealt out between them."""
        steps = df.withColumn("_block", F.explode(F.sequence(F.lit(0), ((many - 1) / UNFOLDED).cast("long"))))
        last = F.least(many, (F.col("_block") + 1) * UNFOLDED) - 1
        return steps.withColumn(name, F.explode(F.sequence(F.col("_block") * UNFOLDED, last))).drop("_block")

    each = unfolded(unfolded(rows, F.col("times"), "repetition"), whole, "piece")
    each = each.select("doc_id", "n", "repetition", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_tokens"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "repetition", "piece"), F.lit(shards)).cast("int"))

    def run(key_, table):
        order = np.lexsort((np.asarray(table["repetition"]), np.asarray(table["n"]), np.asarray(table["piece"]), np.asarray(table["doc_id"].fill_null(-(1 << 63))), -np.asarray(table["n_tokens"])))
        table = table.take(pa.array(order))
        where, offset, capacity = pack(table["n_tokens"].to_pylist(), permitted, overhead)
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "n_tokens": table["n_tokens"], "shard": table["shard"],
            "bin": pa.array(where, pa.int64()), "offset": pa.array(offset, pa.int64()), "capacity": pa.array([capacity[b] for b in where], pa.int64()),
        })

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens long, shard int, bin long, offset long, capacity long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go, by the token counts of operator 1."""
    return packed(token_counts(docs.select("doc_id", "text"), vocabulary(tokenizer_path("piece_bpe_32k.model"))))
