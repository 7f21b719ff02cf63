"""Joins that the corpus work needs beyond plain equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alias_expanded(keys: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """(key, via): each key reaches itself and what it is an alias of; aliases is (key, target).
    A union and an equi-join instead of a join with OR."""
    own = keys.select(key, F.col(key).alias("via"))
    other = keys.join(aliases.select(F.col("key").alias(key), F.col("target").alias("via")), key)
    return own.union(other.select(key, "via")).where(F.col("via").isNotNull()).distinct()


def as_of(rows: DataFrame, key: str, order: list[str], what: Column, *columns: str) -> DataFrame:
    """rows with each of the columns' values at the latest row up to here for which what is true."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.last(F.when(what, F.col(c)), ignorenulls=True).over(upto).alias(f"last_{c}") for c in columns])


def context(rows: DataFrame, key: str, order: list[str], before: int, after: int, column: str) -> DataFrame:
    """rows with the list of a column's values from so many rows before to so many after."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn("context", F.collect_list(column).over(frame))


def nearest(left: DataFrame, right: DataFrame, at: str, before: int, after: int, key: str) -> DataFrame:
    """left with the first row of right whose line lies from at - before to at + after, of equal key.
    Lines are cut into bands as wide as the reach, so that the join has an equality to shuffle by."""
    width = before + after + 1
    spots = left.withColumn("band", F.explode(F.sequence(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width))))
    other = right.select(F.col(key), F.col(at).alias("other_at"), F.col("value"), F.floor(F.col(at) / width).alias("band"))
    met = spots.join(other, [key, "band"]).where(F.col("other_at").between(F.col(at) - before, F.col(at) + after))
    first = met.groupBy(*left.columns).agg(F.min_by("value", "other_at").alias("value"), F.min("other_at").alias("other_at"))
    return first


def located(points: DataFrame, parts: DataFrame, group: str, order: str, size: str, point: str) -> DataFrame:
    """points with the part whose running total of sizes first reaches them: a range join within the group."""
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spans = parts.withColumn("hi", F.sum(size).over(run)).withColumn("lo", F.col("hi") - F.col(size))
    return points.join(spans, group).where((F.col(point) > F.col("lo")) & (F.col(point) <= F.col("hi")))


def positional(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], group: str) -> DataFrame:
    """Rows of two sides of a group that come at the same place of it; left rows stay without a partner."""
    number = lambda df, order: df.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [group, "seq"], "left")


def cascade(rows: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], key: str) -> DataFrame:
    """(key, method, target) of the first step that matches a row.  A step is (method, (keys..., target), keys); a target
    counts only where it is the one target of its keys."""
    found = None
    for rank, (method, table, on) in enumerate(steps):
        single = table.groupBy(*on).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where(F.col("n") == 1).drop("n")
        hits = rows.join(single, on).select(key, F.lit(rank).alias("rank"), F.lit(method).alias("method"), "target")
        found = hits if found is None else found.unionByName(hits)
    first = found.groupBy(key).agg(F.min(F.struct("rank", "method", "target")).alias("m"))
    return rows.select(key).distinct().join(first, key, "left").select(key, F.coalesce("m.method", F.lit("none")).alias("method"), F.col("m.target").alias("target"))


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, doc): documents that hold every term of a needle.  Both sides are postings (needle | doc, term).
    Relational division: a needle's rarest term gives its candidates, and only those are asked for the other terms.
    Postings of the needles' terms are written, so that hay is made once; a needle without terms is in no document."""
    from tessera.operators.graph import stored

    own = stored(hay.select("doc", "term").join(needles.select("term").distinct(), "term", "left_semi"), "containing")
    held = needles.join(own.groupBy("term").agg(F.count("*").alias("n")), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = held.groupBy("needle").agg(F.count("*").alias("need"), F.min_by("term", F.struct("n", "term")).alias("term"))
    asked = rarest.join(own, "term").select("needle", "doc", "need").join(needles, "needle")
    hits = asked.join(own, ["doc", "term"]).groupBy("needle", "doc", "need").agg(F.count("*").alias("have"))
    return hits.where(F.col("have") == F.col("need")).select("needle", "doc")


def redirected(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root, cyclic) for links (node, next): where following them ends.  Each round's pointers reach twice as
    far and are written; a pointer still inside the links after all ends are reached is on or before a cycle, whose
    least node it gets.  rounds bounds chains to 2**rounds links."""
    from tessera.operators.graph import stored

    to = stored(links.groupBy("node").agg(F.min("next").alias("to")).withColumn("low", F.col("to")), "redirects")
    inside = to.select(F.col("node").alias("to"))
    open_before = None
    for _ in range(rounds):
        far = to.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        to = stored(to.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.least("low", F.coalesce("far_low", "low")).alias("low")), "redirects")
        open_now = to.join(inside, "to", "left_semi").agg(F.count("*"), F.sum("low")).first()
        if open_now == open_before or not open_now[0]:
            break
        open_before = open_now
    marked = to.join(inside.withColumn("cyclic", F.lit(True)), "to", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return marked.select("node", F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("to")).alias("root"), "cyclic")
