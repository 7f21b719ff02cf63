"""Extensions: streams, grouping sets, approximate counts; not part of the work the library derives from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import register
from tessera.sources.tables import table
from tessera.streaming import events as S


@register("ext_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return S.drained(S.tumbling(S.source(spark, sf))).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("ext_sliding", "SELECT CAST(epoch(d) AS BIGINT) AS start, CAST(sum(n) AS BIGINT) AS n FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, count(*) FROM events GROUP BY 1) GROUP BY d")
def sliding(spark, sf):
    return S.drained(S.sliding(S.source(spark, sf))).select(F.unix_seconds("start").alias("start"), "n")


@register("ext_sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    return S.sessions(S.batch(spark, sf)).select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("stop").alias("stop"), "n")


@register("ext_stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf):
    stream = S.source(spark, sf)
    return S.drained(S.deduplicated(stream.union(stream)).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@register("ext_cube", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    out = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@register("ext_approx")
def approx(spark, sf):
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_partkey", "l_quantity")
    return rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))
