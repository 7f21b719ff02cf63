"""Graphs as edge tables: components, degrees, chains of neighbours."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a session on this machine alone may leave it unset, and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, whose rows outlive the executors that made them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thinned(edges: DataFrame, held: int = 1 << 18) -> DataFrame:
    """Edges (a, b) that connect what the given ones do: a partition's are held so many at a time, with a star of what went before
    for each component, so that no more go on than a partition has nodes.  Nothing is shuffled."""
    import numpy as np
    import pyarrow as pa

    def stars(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while len(x):
            p, q = label[x], label[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
        far = label != np.arange(len(nodes))
        return nodes[far], nodes[label[far]]

    def run(batches):
        a, b, waiting, n = np.array([], np.int64), np.array([], np.int64), [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= max(held, len(a)):
                a, b = stars(np.concatenate([a, *[w[0] for w in waiting]]), np.concatenate([b, *[w[1] for w in waiting]]))
                waiting, n = [], 0
        a, b = stars(np.concatenate([a, *[w[0] for w in waiting]]), np.concatenate([b, *[w[1] for w in waiting]]))
        for i in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536]), pa.array(b[i : i + 65536])], ["a", "b"])

    return edges.where("a IS NOT NULL AND b IS NOT NULL").select(*[edges[c].cast("long").alias(c) for c in ("a", "b")]).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the least node reachable.  Each node passes the least of its
    neighbourhood on to its neighbours and to its former root, until nothing changes."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("node"), "c"), "labels")
    while True:
        heard = both.join(label, both["a"] == label["node"]).select(F.col("b").alias("node"), "c")
        roots = label.join(label.select(F.col("node").alias("c"), F.col("c").alias("far")), "c").select("node", F.col("far").alias("c"))
        offered = heard.union(roots).union(label)
        # a root hears of the least label that any of its followers heard
        back = label.select("node", F.col("c").alias("root")).join(heard, "node").select(F.col("root").alias("node"), "c")
        new = stored(offered.union(back).groupBy("node").agg(F.min("c").alias("c")), "labels")
        same = new.join(label.withColumnRenamed("c", "old"), "node").where(F.col("c") != F.col("old")).limit(1).count() == 0
        label = new
        if same:
            return label.select("node", F.col("c").alias("component"))


def successions(rows: DataFrame, key: str, order: list[str], node: str) -> DataFrame:
    """(key, src, dst): each pair of neighbours of a chain."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(key, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where(F.col("dst").isNotNull())


def edge_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The k most frequent nodes (node, n) and the edges of at least so many among them."""
    top = nodes.orderBy(F.desc("n"), "node").limit(k)
    keep = F.broadcast(top.select("node"))  # k rows
    inside = edges.where(F.col("n") >= least).join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return top, inside


def weakest(strengths: Column | str, resolved: Column | str, ladder=((3, "sahih"), (2, "hasan"), (1, "daif"))) -> Column:
    """Verdict on a chain from its members' least strength; unknown if a member is unresolved or has none."""
    low = F.min(strengths)
    out = F.when(~F.min(resolved) | (low < 0) | low.isNull(), "unknown")
    for least, verdict in ladder:
        out = out.when(low >= least, verdict)
    return out.otherwise("mawdu")


def positions(rows: DataFrame, key: str, order: list[str], node: str) -> DataFrame:
    """(node, total, first, middle, last): at which end of chains each node stands; a chain of one counts as first."""
    up, down = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    at = rows.select(F.col(node).alias("node"), F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"))
    return at.groupBy("node").agg(F.count("*").alias("total"), F.count_if(F.col("i") == 1).alias("first"), F.count_if((F.col("i") > 1) & (F.col("j") > 1)).alias("middle"), F.count_if((F.col("i") > 1) & (F.col("j") == 1)).alias("last"))
