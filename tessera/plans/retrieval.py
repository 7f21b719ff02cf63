"""Queries on retrieval: vectors, keywords, hybrids, prompts, evaluation, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ranking as R
from tessera.operators import retrieval as V
from tessera.registry import register
from tessera.sources.tables import table

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
TOP = "SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rn FROM s"


def vectors(spark, sf):
    return V.vector_table(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def queries_of(v, every: int = 25):
    return v.where(F.col("id") % every == 0).select(F.col("id").alias("q"), F.col("v").alias("qv"))


@register("rt_vector_topk", f"WITH {VEC}, s AS (SELECT a.id AS q, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 25 = 0), r AS ({TOP}) SELECT * FROM r WHERE rn <= 5")
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    return V.vector_top_k(v.select("id", "v"), queries_of(v), 5)


@register("rt_filtered_topk", f"WITH {VEC}, s AS (SELECT a.id AS q, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id <> b.id AND b.label IN (1, 3, 5) WHERE a.id % 50 = 0), r AS ({TOP}) SELECT * FROM r WHERE rn <= 3")
def filtered_topk(spark, sf):
    v = vectors(spark, sf)
    return V.vector_top_k(v.where(F.col("label").isin(1, 3, 5)).select("id", "v"), queries_of(v, 50), 3)


@register("rt_keyword_and", "SELECT doc_id, lang, substr(text, 1, 60) AS preview FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'idiot') ORDER BY doc_id LIMIT 40")
def keyword_and(spark, sf):
    return table(spark, sf, "documents", "doc_id", "lang", "text").where(V.has_all("text", ["the", "idiot"])).orderBy("doc_id").limit(40).select("doc_id", "lang", F.substring("text", 1, 60).alias("preview"))


@register("rt_hybrid", f"""WITH {VEC}, k AS (SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'worthless') AND contains(lower(text), 'idiot') ORDER BY doc_id LIMIT 8), s AS (SELECT 7 AS q, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id = 7), t AS ({TOP}),
m AS (SELECT id, 'keyword' AS route, 0 AS o, id AS p FROM k UNION ALL SELECT id, 'vector', 1, rn FROM t WHERE rn <= 8 AND (SELECT count(*) FROM k) < 3), f AS (SELECT id, arg_min(route, o) AS route, min(o) AS o, arg_min(p, o) AS p FROM m GROUP BY id)
SELECT id, route, CAST(row_number() OVER (ORDER BY o, p, id) AS INTEGER) AS rn FROM f QUALIFY rn <= 8""")
def hybrid(spark, sf):
    hits = table(spark, sf, "documents", "doc_id", "text").where(V.has_all("text", ["worthless", "idiot"])).select(F.col("doc_id").alias("id"))
    v = vectors(spark, sf)
    near = V.vector_top_k(v.select("id", "v"), v.where("id = 7").select(F.col("id").alias("q"), F.col("v").alias("qv")), 8)
    return V.keyword_first(hits, near.select("id", "rn"), 8)


@register("rt_followup_rewrite", r"""WITH u AS (SELECT conv_id AS conv, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'user')
SELECT conv, turn, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 7 AND b IS NOT NULL THEN b || ' ' || text ELSE text END AS query FROM u""")
def followup_rewrite(spark, sf):
    return V.followed_up(table(spark, sf, "conversations").withColumnRenamed("conv_id", "conv"))


@register("rt_context_blocks", """WITH r AS (SELECT source, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE lang IN ('en', 'fr'))
SELECT source, string_agg('[' || i || '] ' || source || ':' || doc_id || ' (' || lang || ') ' || replace(substr(text, 1, 40), chr(10), ' '), chr(10) ORDER BY i) AS context, count(*) AS n, CAST(sum(least(length(text), 40)) AS BIGINT) AS n_chars FROM r WHERE i <= 5 GROUP BY source""")
def context_blocks(spark, sf):
    docs = table(spark, sf, "documents", "source", "doc_id", "lang", "text").where(F.col("lang").isin("en", "fr"))
    top = R.top(docs.withColumn("n", F.least(F.length("text"), F.lit(40))).withColumn("text", F.substring("text", 1, 40)), 5, "doc_id", by=["source"])
    block = F.concat(F.lit("["), F.col("rn").cast("string"), F.lit("] "), F.col("source"), F.lit(":"), F.col("doc_id").cast("string"), F.lit(" ("), F.col("lang"), F.lit(") "), F.replace("text", F.lit("\n"), F.lit(" ")))
    lists = F.array_sort(F.collect_list(F.struct("rn", block.alias("b"))))
    return top.groupBy("source").agg(F.array_join(F.transform(lists, lambda x: x["b"]), "\n").alias("context"), F.count("*").alias("n"), F.sum("n").cast("long").alias("n_chars"))


@register("rt_model_compare", """WITH h AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:32] AS a, CAST(embedding AS DOUBLE[])[33:64] AS b FROM embeddings), s AS (SELECT x.id AS q, y.id, 'a' AS model, round(list_cosine_similarity(x.a, y.a), 6) AS score FROM h x JOIN h y ON x.id <> y.id WHERE x.id % 40 = 0 UNION ALL SELECT x.id, y.id, 'b', round(list_cosine_similarity(x.b, y.b), 6) FROM h x JOIN h y ON x.id <> y.id WHERE x.id % 40 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q, model ORDER BY score DESC, id) AS rn FROM s), g AS (SELECT q, max(score) FILTER (model = 'a' AND rn = 1) AS ta, max(score) FILTER (model = 'b' AND rn = 1) AS tb, list(id) FILTER (model = 'a') AS ia, list(id) FILTER (model = 'b') AS ib FROM r WHERE rn <= 5 GROUP BY q)
SELECT count(*) AS n_queries, round(avg(ta), 6) AS avg_top_a, round(avg(tb), 6) AS avg_top_b, count(*) FILTER (ta > tb) AS wins_a, round(avg(len(list_intersect(ia, ib))), 6) AS overlap FROM g""")
def model_compare(spark, sf):
    v, out = vectors(spark, sf), None
    for model, start in (("a", 1), ("b", 33)):
        half = v.select("id", F.slice("v", start, 32).alias("v"))
        found = V.vector_top_k(half, queries_of(half, 40), 5).withColumn("model", F.lit(model))
        out = found if out is None else out.union(found)
    return V.compared(out, "a", "b")


@register("rt_stratified_sample", "WITH q AS (SELECT source, CAST(ceil(count(*) / (SELECT count(*) FROM documents) * 100) AS BIGINT) AS quota FROM documents GROUP BY source), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) SELECT r.source, r.doc_id, quota FROM r JOIN q USING (source) WHERE rn <= quota")
def stratified_sample(spark, sf):
    return R.stratified(table(spark, sf, "documents", "source", "doc_id"), "source", F.md5(F.col("doc_id").cast("string")), 100).select("source", "doc_id", "quota")


@register("rt_router", r"""WITH q AS (SELECT conv_id, turn, text, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[\x{00C0}-\x{024F}]', '', 'g'))) / length(text) END AS s, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 2)) AS n FROM conversations WHERE role = 'user')
SELECT CASE WHEN s > 0.03 THEN 'concordance' WHEN n >= 2 THEN 'keyword' ELSE 'vector' END AS route, count(*) AS n, CAST(sum(least(length(text), 500) + 20) AS BIGINT) AS prompt_chars FROM q GROUP BY 1""")
def router(spark, sf):
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    return turns.groupBy(V.routed("text").alias("route")).agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(500)) + 20).cast("long").alias("prompt_chars"))


@register("tk_seeded_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 20")
def seeded_sample(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return rows.orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(20)


@register("rt_coverage_rank", "WITH d AS (SELECT label, count(*) AS n, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), [1.0] || list_resize([0.0], 63, 0.0))), 6) AS mean FROM embeddings GROUP BY label) SELECT label, n, mean, CAST(row_number() OVER (ORDER BY mean DESC, label) AS INTEGER) AS rn FROM d")
def coverage_rank(spark, sf):
    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 63))
    means = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine("embedding", one)), 6).alias("mean"))
    return means.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "label")))
