"""Matching of free names to graded profiles: strategies in order, name variants, conflicts by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

#: Words of a name that don't tell persons apart.
PARTICLES = ("بن", "ابن", "بنت", "ابو", "ابي", "ام", "عن")
ORDER = ("manual", "exact", "all words", "kunya", "byname", "first name", "son of")


def distinct_words(name: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(T.col(name), " "), lambda w: (F.length(w) > 1) & ~w.isin(*PARTICLES)))


def nominative(name: Column | str) -> Column:
    """A leading father-of in the nominative."""
    return F.regexp_replace(T.col(name), "^ابي ", "ابو ")


def matched(names: DataFrame, profiles: DataFrame, aliases: DataFrame | None = None, grades=L.GRADES) -> DataFrame:
    """(name, strategy, key, grade) of names (name) among profiles (key, name, grade) by the first strategy that decides.

    Candidates of every strategy come from equi-joins; a strategy decides where it has one candidate, or one of the
    best grade among them (exact names: the first by key).  aliases (name, target): a target that is null rules a name out."""
    rank = F.create_map(*[F.lit(x) for i, g in enumerate(grades) for x in (g, i)])
    cleaned = T.normalised(F.regexp_replace(T.clean_name("name"), "[\\u0640-]+$", ""), "match")
    q = names.select("name").distinct().select("name", cleaned.alias("clean")).withColumn("words", distinct_words("clean")).where(F.size("words") > 0)
    p = profiles.select("key", T.primary_name("name").alias("pn"), "grade", F.coalesce(rank[F.col("grade")], F.lit(99)).alias("rank")).withColumn("words", distinct_words("pn"))
    spread = p.select("key", "pn", "grade", "rank", F.explode("words").alias("word"), F.get("words", F.lit(0)).alias("lead"))
    out = lambda df, strategy, prefer=None: df.select("name", F.lit(ORDER.index(strategy)).alias("s"), "key", "grade", "rank", (F.lit(0) if prefer is None else prefer).alias("pref"))
    one = q.where(F.size("words") == 1).withColumn("word", F.get("words", F.lit(0)))

    exact = out(q.join(p.drop("words"), F.col("clean") == F.col("pn")), "exact")
    need = q.where(F.size("words") >= 2).select("name", F.size("words").alias("need"), F.explode("words").alias("word"))
    whole = need.join(spread, "word").groupBy("name", "need", "key", "grade", "rank").agg(F.count("*").alias("have")).where("have = need")
    kunya = T.kunya(nominative("clean"))
    by_kunya = q.withColumn("kw", kunya).join(p.drop("words").withColumn("kw", T.kunya(nominative("pn"))), "kw")
    byname = one.where(F.col("word").startswith("ال")).drop("words").join(spread, "word")
    lead = F.when(F.col("lead") == F.col("word"), 0).otherwise(1)
    first = one.drop("words").join(spread.where("lead = word"), "word")
    son = q.where(F.col("clean").startswith("ابن ")).select("name", F.get("words", F.lit(0)).alias("word")).join(spread, "word")
    found = exact.union(out(whole, "all words")).union(out(by_kunya, "kunya")).union(out(byname, "byname", lead)).union(out(first, "first name")).union(out(son, "son of"))
    ruled_out = None
    if aliases is not None:
        a = aliases.select(F.col("name").alias("clean"), "target")
        told = q.drop("words").withColumn("clean", nominative("clean")).join(a, "clean").union(q.drop("words").join(a, "clean").select("clean", "name", "target")).select("name", "target").distinct()
        ruled_out = told.where("target IS NULL").select("name")
        hits = told.join(p.drop("words"), F.col("target") == F.col("pn")).withColumn("pref", F.lit(0))
        prefix = told.join(p.drop("words"), F.substring("target", 1, 30) == F.substring("pn", 1, 30)).withColumn("pref", F.lit(1))
        found = found.union(out(hits.union(prefix), "manual", F.col("pref")))
    per = Window.partitionBy("name", "s")
    decided = found.distinct().withColumn("best", F.min("pref").over(per)).where("pref = best").withColumn("top", F.min("rank").over(per)).where("rank = top")
    decided = decided.groupBy("name", "s").agg(F.count("*").alias("n"), F.min_by("grade", "key").alias("grade"), F.min("key").alias("key"))
    decided = decided.where((F.col("n") == 1) | F.col("s").isin(ORDER.index("exact"), ORDER.index("manual")))
    best = decided.groupBy("name").agg(F.min(F.struct("s", "key", "grade")).alias("m"))
    named = F.when(F.col("m").isNull(), F.lit("none"))
    for i, x in enumerate(ORDER):
        named = named.when(F.col("m.s") == i, x)
    result = names.select("name").distinct().join(best, "name", "left").select("name", named.alias("strategy"), "m.key", "m.grade")
    if ruled_out is None:
        return result
    skip = result.join(ruled_out.withColumn("out", F.lit(True)), "name", "left")
    return skip.select("name", F.when(F.col("out"), "ruled out").otherwise(F.col("strategy")).alias("strategy"), F.when(F.col("out").isNull(), F.col("key")).alias("key"), F.when(F.col("out").isNull(), F.col("grade")).alias("grade"))


def variants(name: Column | str) -> Column:
    """Spellings under which a name may be indexed, itself first: a leading particle off, a son-of off, father-of in other cases."""

    def made(n: Column) -> Column:
        head, rest = F.substring_index(n, " ", 1), F.regexp_extract(n, "^\\S+(.*)$", 1)
        bare = F.when((F.length(head) >= 5) & head.startswith("لل"), F.concat(F.lit("ال"), F.substr(head, F.lit(3)), rest)).when((F.length(head) >= 4) & head.rlike("^[ولفب]"), F.concat(F.substr(head, F.lit(2)), rest))
        forms = F.array_compact(F.array(n, bare, F.when(n.startswith("ابن "), F.substr(n, F.lit(5)))))
        swap = lambda v, a, b: F.regexp_replace(v, f"(?<![\\p{{L}}]){a}(?![\\p{{L}}])", b)
        return F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, lambda v: F.array(swap(v, "ابي", "ابو"), swap(v, "ابو", "ابي"), swap(v, "ابا", "ابو"))))))

    return T.bound(T.col(name), made)


def resolved(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, pid) of names (name) in an index (name, pid, freq): the first variant that is there; of several profiles of
    one name the most frequent counts, ties to the smaller pid."""
    own = index.groupBy(F.col("name").alias("v")).agg(F.min_by("pid", F.struct(-F.col("freq"), "pid")).alias("pid"))
    tried = names.select("name", F.posexplode(variants(T.normalised("name", "viewer"))).alias("i", "v")).join(own, "v")
    return names.select("name").distinct().join(tried.groupBy("name").agg(F.min_by("pid", "i").alias("pid")), "name", "left")
