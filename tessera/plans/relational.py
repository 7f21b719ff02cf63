"""Queries on the star schema and the event table: ranks, matrices, shares, joins by place, facets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.operators import joins as J
from tessera.operators import ranking as R
from tessera.registry import register
from tessera.sources.tables import table


@register("cq_rank_delta", """WITH s AS (SELECT p_partkey, p_retailprice AS price, CAST(sum(l_quantity) AS BIGINT) AS qty FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY price DESC, p_partkey) AS rank_price, row_number() OVER (ORDER BY qty DESC, p_partkey) AS rank_qty FROM s) SELECT p_partkey, rank_price, rank_qty, rank_price - rank_qty AS delta FROM r""")
def rank_delta(spark, sf):
    sold = table(spark, sf, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("qty"))
    both = table(spark, sf, "part", "p_partkey", "p_retailprice").join(sold, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.col("p_retailprice").alias("price"), "qty")
    return R.ranks(both, "p_partkey", "price", "qty").select("p_partkey", "rank_price", "rank_qty", (F.col("rank_price") - F.col("rank_qty")).alias("delta"))


@register("cq_book_family_matrix", "WITH k AS (SELECT n_name, m FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer)), c AS (SELECT n_name, c_mktsegment AS m, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY ALL) SELECT k.n_name, k.m AS segment, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (n_name, m)")
def book_family_matrix(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    counts = customer.where(F.col("c_acctbal") > 5000).groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    named = counts.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "segment", "n")
    return R.filled_matrix(named, nation.select("n_name"), customer.select(F.col("c_mktsegment").alias("segment")).distinct(), "n").select("n_name", "segment", "n")


@register("cq_family_overlap", "WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM m x JOIN m y USING (l_orderkey) WHERE x.p_brand < y.p_brand GROUP BY ALL")
def family_overlap(spark, sf):
    return R.overlaps(brands_of_orders(spark, sf), "l_orderkey", "p_brand")


def brands_of_orders(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_brand")
    return table(spark, sf, "lineitem", "l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")


@register("cq_distinctiveness", """WITH c AS (SELECT n_name, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY n_name) * sum(n) OVER (PARTITION BY segment) / sum(n) OVER () AS expected FROM c) SELECT n_name, segment, n, round(expected, 6) AS expected, round(n / expected, 6) AS lift FROM e WHERE n > 1.12 * expected""")
def distinctiveness(spark, sf):
    counts = table(spark, sf, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    named = counts.join(F.broadcast(table(spark, sf, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "segment", "n")
    return R.distinctive(named, "n_name", "segment", "n").select("n_name", "segment", "n", F.round("expected", 6).alias("expected"), F.round("lift", 6).alias("lift"))


TYPES = ("click", "error", "purchase", "signup", "view")


@register("cq_narr_book_pivot", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY user_id), g AS (SELECT user_id FROM t ORDER BY total DESC, user_id LIMIT 20), b AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM c) WHERE rn = 1), s AS (SELECT user_id FROM g UNION SELECT user_id FROM b) SELECT user_id, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (event_type = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in TYPES) + " FROM c JOIN s USING (user_id) GROUP BY user_id")
def narr_book_pivot(spark, sf):
    counts = table(spark, sf, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("user_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "user_id").limit(20).select("user_id")
    best = R.top(counts, 1, F.desc("n"), "user_id", by=["event_type"]).select("user_id")
    chosen = counts.join(F.broadcast(top.union(best).distinct()), "user_id", "left_semi")  # 20 and one a type
    return chosen.groupBy("user_id").pivot("event_type", list(TYPES)).agg(F.sum("n")).fillna(0, list(TYPES))


@register("cq_profile_index", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS types, string_agg(event_type || ':' || CAST(round_even(100.0 * n / tot, 0) AS BIGINT), ',' ORDER BY n DESC, event_type) FILTER (floor(100.0 * n / tot) >= 2) AS pct FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS tot FROM c) GROUP BY user_id HAVING sum(n) >= 3),
s AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS sample FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i <= 5 GROUP BY user_id) SELECT t.*, s.sample FROM t JOIN s USING (user_id)""")
def profile_index(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_type", "event_id")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    per = counts.groupBy("user_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("l")).where(F.col("total") >= 3)
    pct = lambda x: -x["m"] * 100.0 / F.col("total")
    shown = F.transform(F.filter("l", lambda x: F.floor(pct(x)) >= 2), lambda x: F.concat(x["event_type"], F.lit(":"), F.bround(pct(x), 0).cast("long").cast("string")))
    typed = per.select("user_id", "total", F.array_join(F.transform("l", lambda x: F.concat(x["event_type"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("types"), F.array_join(shown, ",").alias("pct"))
    first = R.top(events, 5, "event_id", by=["user_id"]).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return typed.join(first, "user_id")


@register("cq_root_cooccur", """WITH b AS (SELECT DISTINCT l_orderkey, p_type AS t FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT t, count(*) AS total FROM b GROUP BY t), c AS (SELECT x.t AS a, y.t AS b, count(*) AS shared FROM b x JOIN b y USING (l_orderkey) WHERE x.t <> y.t GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS i FROM c JOIN n ON n.t = c.a WHERE shared >= 2 AND shared / total < 0.9) SELECT a, b, shared, CAST(i AS INTEGER) AS rn FROM r WHERE i <= 8""")
def root_cooccur(spark, sf):
    types = table(spark, sf, "lineitem", "l_orderkey", "l_partkey").join(table(spark, sf, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()
    half = R.overlaps(types, "l_orderkey", "p_type")
    both = half.union(half.select("b", "a", "n")).withColumnRenamed("n", "shared")
    total = types.groupBy(F.col("p_type").alias("a")).agg(F.count("*").alias("total"))
    kept = both.join(F.broadcast(total), "a").where((F.col("shared") >= 2) & (F.col("shared") / F.col("total") < 0.9))
    return R.top(kept, 8, F.desc("shared"), "b", by=["a"]).select("a", "b", "shared", "rn")


@register("cq_cooccur_raw", "WITH b AS (SELECT l_orderkey, l_suppkey % 50 AS g FROM lineitem GROUP BY ALL) SELECT x.g AS a, y.g AS b, count(*) AS n FROM b x JOIN b y USING (l_orderkey) WHERE x.g < y.g GROUP BY ALL")
def cooccur_raw(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey").select("l_orderkey", (F.col("l_suppkey") % 50).alias("g"))
    return R.overlaps(rows, "l_orderkey", "g")


@register("jn_ffill_asof", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_value, event_type FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY event_type = 'error'""")
def ffill_asof(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    return J.as_of(events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "event_id", "value").where(F.col("event_type") == "error").select("event_id", "user_id", "last_event_id", "last_value", "event_type")


@register("jn_context_window", "SELECT conv_id, turn, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS context FROM conversations")
def context_window(spark, sf):
    rows = J.context(table(spark, sf, "conversations", "conv_id", "turn", "role"), "conv_id", ["turn"], 3, 2, "role")
    return rows.select("conv_id", "turn", F.array_join("context", ",").alias("context"))


@register("jn_cumulative_locate", """WITH c AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hi FROM c)
SELECT o_custkey, v.point, o_orderkey FROM s, (VALUES (1), (5), (20), (40)) v(point) WHERE point > hi - n AND point <= hi""")
def cumulative_locate(spark, sf):
    sizes = table(spark, sf, "orders", "o_orderkey", "o_custkey").join(table(spark, sf, "lineitem", "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    points = sizes.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(*[F.lit(i) for i in (1, 5, 20, 40)])).alias("point"))
    return J.located(points, sizes, "o_custkey", "o_orderkey", "n", "point").select("o_custkey", "point", "o_orderkey")


@register("jn_positional", """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM documents), l AS (SELECT source, l.doc_id AS label_id, quality, row_number() OVER (PARTITION BY source ORDER BY l.doc_id) AS seq FROM labels l JOIN documents USING (doc_id))
SELECT d.source, d.doc_id, d.seq, l.label_id, l.quality FROM d LEFT JOIN l USING (source, seq)""")
def positional(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source")
    marks = table(spark, sf, "labels", "doc_id", "quality").join(docs, "doc_id").select("source", F.col("doc_id").alias("label_id"), "quality")
    out = J.positional(docs, marks, ["doc_id"], ["label_id"], "source")
    return out.select("source", "doc_id", F.col("seq").cast("long").alias("seq"), "label_id", "quality")


@register("tk_paging", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 15 OFFSET 30")
def paging(spark, sf):
    return R.paged(table(spark, sf, "supplier", "s_suppkey", "s_name", "s_acctbal"), 2, 15, F.desc("s_acctbal"), "s_suppkey")


@register("sk_partition_manifest", "SELECT coalesce(nullif(o_orderstatus, ''), 'unknown') AS part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def partition_manifest(spark, sf):
    from tessera.sources.sinks import manifest

    return manifest(table(spark, sf, "orders", "o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey")


@register("cq_enrich_fill", """SELECT c_custkey, n_name, r_name, s.n_suppliers, coalesce(s.best, c_acctbal) AS filled, s.best IS NOT NULL AS from_supplier FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers, max(s_acctbal) AS best FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) s ON s.s_nationkey = c_nationkey""")
def enrich_fill(spark, sf):
    places = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    offers = table(spark, sf, "supplier").where(F.col("s_acctbal") > 3000).groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"), F.max("s_acctbal").alias("best"))
    dims = places.join(offers, F.col("s_nationkey") == F.col("n_nationkey"), "left")  # a row a nation
    out = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", "n_suppliers", F.coalesce("best", "c_acctbal").alias("filled"), F.col("best").isNotNull().alias("from_supplier"))


@register("cq_category_chapters", """WITH c AS (SELECT p_brand AS category, min(p_partkey) AS first_key FROM part GROUP BY p_brand), o AS (SELECT *, CAST(dense_rank() OVER (ORDER BY first_key) AS INTEGER) AS ord FROM c), t AS (SELECT DISTINCT p_type FROM part), n AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL)
SELECT o.ord, o.category, t.p_type, coalesce(n.n, 0) AS n FROM o CROSS JOIN t LEFT JOIN n ON n.p_brand = o.category AND n.p_type = t.p_type""")
def category_chapters(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size")
    order = parts.groupBy(F.col("p_brand").alias("category")).agg(F.min("p_partkey").alias("f")).withColumn("ord", F.dense_rank().over(Window.orderBy("f"))).drop("f")
    counts = parts.where(F.col("p_size") > 25).groupBy(F.col("p_brand").alias("category"), "p_type").agg(F.count("*").alias("n"))
    return R.filled_matrix(counts.join(F.broadcast(order), "category"), order, parts.select("p_type").distinct(), "n").select("ord", "category", "p_type", "n")


@register("cq_group_share", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share_of_status, round(n / max(n) OVER (), 6) AS of_max FROM c")
def group_share(spark, sf):
    counts = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    own = R.shares(R.shares(counts, "n").withColumnRenamed("share", "all_share"), "n", ["o_orderstatus"])
    return own.select("o_orderstatus", "o_orderpriority", "n", F.round("all_share", 6).alias("share"), F.round("share", 6).alias("share_of_status"), F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("of_max"))


@register("cq_cited_flag", "SELECT source, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, round(count(l.doc_id) / count(*), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def cited_flag(spark, sf):
    marks = table(spark, sf, "labels", "doc_id", "quality").withColumn("cited", F.lit(True))
    both = table(spark, sf, "documents", "doc_id", "source").join(marks, "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("cited").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.round(F.count("cited") / F.count("*"), 6).alias("share"))


@register("cq_dashboard_feeds", """(SELECT 'brand' AS feed, p_brand AS name, count(*) AS x, CAST(sum(l_quantity) AS BIGINT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY y DESC, name LIMIT 15)
UNION ALL (SELECT 'source', source, count(*), CAST(sum(n_chars) AS BIGINT) AS y FROM documents GROUP BY source ORDER BY y DESC, source LIMIT 15)""")
def dashboard_feeds(spark, sf):
    brands = table(spark, sf, "lineitem", "l_partkey", "l_quantity").join(table(spark, sf, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    a = brands.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("x"), F.sum("l_quantity").cast("long").alias("y"))
    b = table(spark, sf, "documents", "source", "n_chars").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("x"), F.sum("n_chars").alias("y"))
    feed = lambda df, kind: df.orderBy(F.desc("y"), "name").limit(15).select(F.lit(kind).alias("feed"), "name", "x", "y")
    return feed(a, "brand").union(feed(b, "source"))


@register("pf_point_lookup", "SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS value FROM orders WHERE o_orderkey IN (1, 7, 500) UNION ALL SELECT 'doc', doc_id, lang FROM documents WHERE source = 'src3' AND doc_id BETWEEN 100 AND 300")
def point_lookup(spark, sf):
    a = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderkey").isin(1, 7, 500)).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    b = table(spark, sf, "documents", "doc_id", "lang", "source").where((F.col("source") == "src3") & F.col("doc_id").between(100, 300)).select(F.lit("doc"), "doc_id", "lang")
    return a.union(b)


@register("cq_corpus_totals", """WITH g AS (SELECT 'documents' AS t, lang AS g, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang UNION ALL SELECT 'conversations', role, count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY role UNION ALL SELECT 'pages', 'html', count(*), CAST(sum(length(html)) AS BIGINT) FROM pages)
SELECT t, g, n, chars, round(100.0 * n / max(n) OVER (), 6) AS pct_of_max FROM g UNION ALL SELECT 'all', 'all', CAST(sum(n) AS BIGINT), CAST(sum(chars) AS BIGINT), NULL FROM g""")
def corpus_totals(spark, sf):
    total = lambda name, g, size: table(spark, sf, name).groupBy(F.lit(name).alias("t"), g.alias("g")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("chars"))
    rows = total("documents", F.col("lang"), F.col("n_chars")).union(total("conversations", F.col("role"), F.length("text"))).union(total("pages", F.lit("html"), F.length("html")))
    one = rows.withColumn("pct_of_max", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy()), 6))
    return one.union(rows.agg(F.lit("all"), F.lit("all"), F.sum("n"), F.sum("chars"), F.lit(None).cast("double")))


@register("cq_search_index", """SELECT d.doc_id, d.source, substr(d.text, 1, 50) AS preview, coalesce(l.quality, -1) AS quality, CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' ELSE 'unknown' END AS grade, s.n_docs FROM documents d LEFT JOIN labels l USING (doc_id)
JOIN (SELECT source, count(*) AS n_docs FROM documents GROUP BY source) s USING (source) WHERE d.lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 100)""")
def search_index(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "lang", "text")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    langs = docs.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= 100).select("lang")
    heads = docs.select("doc_id", "source", "lang", F.substring("text", 1, 50).alias("preview"))
    out = heads.join(langs, "lang", "left_semi").join(sizes, "source").join(table(spark, sf, "labels"), "doc_id", "left")
    grade = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("unknown")
    return out.select("doc_id", "source", "preview", F.coalesce("quality", F.lit(-1)).alias("quality"), grade.alias("grade"), "n_docs")


@register("pf_predicates", """SELECT d.doc_id, coalesce(nullif(trim(d.source), ''), d.lang) AS first_value, length(d.text) >= 500 AS long_text FROM documents d WHERE length(d.text) >= 50 AND d.lang NOT IN ('es') AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def predicates(spark, sf):
    from tessera.functions.text import first_of

    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").where((F.length("text") >= 50) & ~F.col("lang").isin("es"))
    kept = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return kept.select("doc_id", first_of("source", "lang").alias("first_value"), (F.length("text") >= 500).alias("long_text"))


@register("pf_facets", "SELECT c_mktsegment AS facet, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND contains(lower(c_name), '1') AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def facets(spark, sf):
    kept = table(spark, sf, "customer").where((F.col("c_acctbal") > 0) & F.contains(F.lower("c_name"), F.lit("1")) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return kept.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("facet"), "n_name").agg(F.count("*").alias("n"))


@register("ag_verse_sum", """WITH b AS (SELECT p_brand, count(DISTINCT l_orderkey) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand), m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS related, count(*) AS n_brands, max_by(p_brand, c * 1000000 - CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)) AS dominant FROM m JOIN b USING (p_brand) GROUP BY l_orderkey)
SELECT *, CASE WHEN n_brands >= 7 THEN 'wide' WHEN n_brands >= 4 THEN 'mid' ELSE 'narrow' END AS label FROM s ORDER BY related DESC, l_orderkey LIMIT 50""".replace("\\\\", "\\"))
def verse_sum(spark, sf):
    members = brands_of_orders(spark, sf).distinct()
    sizes = members.groupBy("p_brand").agg(F.count("*").alias("c"))
    number = F.regexp_extract("p_brand", "(\\d+)", 1).cast("long")
    sums = members.join(F.broadcast(sizes), "p_brand").groupBy("l_orderkey").agg(F.sum("c").alias("related"), F.count("*").alias("n_brands"), F.max_by("p_brand", F.col("c") * 1_000_000 - number).alias("dominant"))
    label = F.when(F.col("n_brands") >= 7, "wide").when(F.col("n_brands") >= 4, "mid").otherwise("narrow")
    return sums.withColumn("label", label).orderBy(F.desc("related"), "l_orderkey").limit(50)


@register("ag_nested_rollup", """SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, coalesce(CAST(y AS VARCHAR), '*') AS year, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (o_orderstatus, o_orderpriority, y)""")
def nested_rollup(spark, sf):
    rows = table(spark, sf, "orders", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey").withColumn("y", F.year("o_orderdate"))
    out = rows.rollup("o_orderstatus", "o_orderpriority", "y").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    return out.select(star("o_orderstatus").alias("status"), star("o_orderpriority").alias("priority"), star("y").alias("year"), "n", "n_customers")


@register("ag_degree", """WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), d AS (SELECT 'customer' AS side, c AS id, count(*) AS degree FROM e GROUP BY c UNION ALL SELECT 'supplier', s, count(*) FROM e GROUP BY s) SELECT side, degree, count(*) AS n, min(id) AS first_id FROM d GROUP BY side, degree""")
def degree(spark, sf):
    edges = table(spark, sf, "orders", "o_orderkey", "o_custkey").join(table(spark, sf, "lineitem", "l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    own = lambda side, c: edges.groupBy(F.lit(side).alias("side"), F.col(c).alias("id")).agg(F.count("*").alias("degree"))
    return own("customer", "o_custkey").union(own("supplier", "l_suppkey")).groupBy("side", "degree").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@register("cq_network_matrix", "WITH c AS (SELECT user_id % 20 AS u, event_type AS t, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY u) * sum(n) OVER (PARTITION BY t) / sum(n) OVER () AS expected FROM c) SELECT u, t, n, round(n - expected, 6) AS excess FROM e WHERE n > expected ORDER BY excess DESC, u, t LIMIT 30")
def network_matrix(spark, sf):
    counts = table(spark, sf, "events", "user_id", "event_type").groupBy((F.col("user_id") % 20).alias("u"), F.col("event_type").alias("t")).agg(F.count("*").alias("n"))
    return R.distinctive(counts, "u", "t", "n", 1.0).select("u", "t", "n", F.round(F.col("n") - F.col("expected"), 6).alias("excess")).orderBy(F.desc("excess"), "u", "t").limit(30)


@register("cq_connected_preview", """WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS total, CASE WHEN doc_id % 10 = 3 THEN doc_id - 3 ELSE NULL END AS alias FROM documents),
a AS (SELECT r.source, r.doc_id, coalesce(d.lang, r.lang) AS lang, r.alias IS NOT NULL AS aliased, r.i, r.total FROM r LEFT JOIN documents d ON d.doc_id = r.alias WHERE i <= 25) SELECT source, max(total) AS total, count(*) AS shown, string_agg(doc_id || ':' || lang, ',' ORDER BY doc_id) AS preview, count(*) FILTER (aliased) AS n_aliased FROM a GROUP BY source""")
def connected_preview(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "lang")
    own = Window.partitionBy("source")
    rows = docs.withColumn("i", F.row_number().over(own.orderBy("doc_id"))).withColumn("total", F.count("*").over(own)).where(F.col("i") <= 25)
    rows = rows.withColumn("alias", F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") - 3))
    full = rows.join(docs.select(F.col("doc_id").alias("alias"), F.col("lang").alias("other")), "alias", "left")
    item = F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("other", "lang")).alias("t"))
    return full.groupBy("source").agg(F.max("total").alias("total"), F.count("*").alias("shown"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("preview"), F.count("alias").alias("n_aliased"))


@register("qa_bitmask", "WITH m AS (SELECT doc_id, quality + 2 * toxic + 4 * CAST(doc_id % 3 = 0 AS INTEGER) AS mask FROM labels) SELECT mask, count(*) AS n, (mask & 2) = 0 AS shown, array_to_string(list_filter([CASE WHEN mask & 1 > 0 THEN 'good' END, CASE WHEN mask & 2 > 0 THEN 'toxic' END, CASE WHEN mask & 4 > 0 THEN 'third' END], lambda x: x IS NOT NULL), '|') AS names FROM m GROUP BY mask")
def bitmask(spark, sf):
    flags = {"good": 1, "toxic": 2, "third": 4}
    mask = table(spark, sf, "labels").select((F.col("quality") + 2 * F.col("toxic") + 4 * (F.col("doc_id") % 3 == 0).cast("int")).alias("mask"))
    names = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(b) > 0, F.lit(k)) for k, b in flags.items()]))
    return mask.groupBy("mask").agg(F.count("*").alias("n")).select("mask", "n", (F.col("mask").bitwiseAND(2) == 0).alias("shown"), F.array_join(names, "|").alias("names"))


@register("qa_scans", """WITH x AS (SELECT 'late' AS class, l_orderkey AS id, l_quantity AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 110 OR l_shipdate < o_orderdate
UNION ALL SELECT 'free', l_orderkey, l_quantity FROM lineitem WHERE l_discount >= 0.1 AND l_tax <= 0.01 UNION ALL SELECT 'priceless', o_orderkey, 1.0 FROM orders WHERE o_totalprice < 1000) SELECT class, count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id, CAST(sum(w) AS BIGINT) AS weight FROM x GROUP BY class""")
def scans(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    both = lines.select("l_orderkey", "l_quantity", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = both.where((F.datediff("l_shipdate", "o_orderdate") > 110) | (F.col("l_shipdate") < F.col("o_orderdate"))).select(F.lit("late").alias("class"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("w"))
    free = lines.where((F.col("l_discount") >= 0.1) & (F.col("l_tax") <= 0.01)).select(F.lit("free"), "l_orderkey", "l_quantity")
    cheap = orders.where(F.col("o_totalprice") < 1000).select(F.lit("priceless"), "o_orderkey", F.lit(1.0))
    return late.union(free).union(cheap).groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.sum("w").cast("long").alias("weight"))


@register("qa_coverage", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), l AS (SELECT source, count(*) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT coalesce(c.source, l.source) AS source, coalesce(n, 0) AS n, coalesce(labelled, 0) AS labelled, round(100.0 * coalesce(labelled, 0) / n, 6) AS pct, CASE WHEN 100.0 * coalesce(labelled, 0) / n < 40 AND n > 20 THEN 'low' WHEN toxic > 5 THEN 'toxic' ELSE 'ok' END AS note, CASE WHEN coalesce(toxic, 0) > 0 THEN CAST(floor(labelled / toxic + 0.5) AS BIGINT) END AS ratio FROM c FULL JOIN l ON c.source = l.source""")
def coverage(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source")
    marks = table(spark, sf, "labels", "doc_id", "toxic").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    out = docs.groupBy("source").agg(F.count("*").alias("n")).join(marks, "source", "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("labelled", F.coalesce("labelled", F.lit(0)))
    pct = 100.0 * F.col("labelled") / F.nullif(F.col("n"), F.lit(0))
    note = F.when((pct < 40) & (F.col("n") > 20), "low").when(F.col("toxic") > 5, "toxic").otherwise("ok")
    return out.select("source", "n", "labelled", F.round(pct, 6).alias("pct"), note.alias("note"), F.when(F.col("toxic") > 0, half_up(F.col("labelled") / F.nullif(F.col("toxic"), F.lit(0)))).alias("ratio"))


@register("io_roundtrip", "SELECT n_regionkey AS k, count(*) AS n, min(n_name) AS first_name, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def io_roundtrip(spark, sf):
    """The nations through every sink and back: Parquet by part, JSON, CSV, and an atomic replacement."""
    import uuid

    from tessera.operators.graph import shared_dir
    from tessera.sources import sinks

    at = f"{shared_dir(spark).rstrip('/')}/tessera-roundtrip-{uuid.uuid4().hex}"
    nation = table(spark, sf, "nation")
    kinds = "n_nationkey int, n_name string, n_regionkey int"
    sinks.partitioned(nation, f"{at}/parts", "n_regionkey")
    back = spark.read.parquet(f"{at}/parts").select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
    sinks.json_lines(back, f"{at}/json")
    back = spark.read.schema(kinds).json(f"{at}/json")
    sinks.csv_union([back], f"{at}/csv", "n_nationkey")
    back = spark.read.schema(kinds).csv(f"{at}/csv", header=True)
    sinks.replaced(back, f"{at}/table")
    return spark.read.parquet(f"{at}/table").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"), F.sum("n_nationkey").alias("total"))
