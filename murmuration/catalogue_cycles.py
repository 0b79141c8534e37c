"""The event stream in monitoring cycles, with state that lasts from cycle to cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.catalogue import ORACLES, query, tfidf_terms
from murmuration.operators import reports, text
from murmuration.plans.checkpoints import stored_stream
from murmuration.sources import sessions, tables
from murmuration.streaming import cycles


@query("monitor_cycles", """{C}, h AS (SELECT *, us // 3600000000 AS hour FROM c), z AS (SELECT (max(us) - 1000000) // 3600000000 AS last FROM c), s AS (SELECT hour, count(*) AS posts, max(least(likes, 100))::DOUBLE AS score, avg(likes)::DOUBLE AS engagement FROM h, z WHERE hour < last GROUP BY 1),
b AS (SELECT DISTINCT hour, author FROM h WHERE action = 'error'), nb AS (SELECT hour, count(*) AS k FROM b x WHERE NOT EXISTS (FROM b y WHERE y.hour = x.hour - 1 AND y.author = x.author) GROUP BY 1),
t AS (SELECT hour, url FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY hour ORDER BY count(*) DESC, url) <= 10), nt AS (SELECT hour, count(*) AS k FROM t x WHERE NOT EXISTS (FROM t y WHERE y.hour = x.hour - 1 AND y.url = x.url) GROUP BY 1),
a AS (SELECT * FROM s UNION ALL SELECT hour + 1, 0, 0, 0 FROM s, z WHERE hour + 1 < last AND hour + 1 NOT IN (SELECT hour FROM s)),
r AS (SELECT a.hour, row_number() OVER w AS number, posts, score, lag(score, 1, 0) OVER w AS old_score, engagement, lag(engagement, 1, engagement) OVER w AS old_engagement, CASE WHEN posts > 0 THEN coalesce(nb.k, 0) ELSE 0 END AS new_bots, CASE WHEN posts > 0 THEN coalesce(nt.k, 0) ELSE 0 END AS new_terms
  FROM a LEFT JOIN nb ON nb.hour = a.hour LEFT JOIN nt ON nt.hour = a.hour WINDOW w AS (ORDER BY a.hour)),
f AS (SELECT *, new_bots >= 3 AS bots, score - old_score >= 15 AND score >= 40 AS spike, new_terms >= 4 AS terms, engagement - old_engagement >= 0.5::DOUBLE * greatest(old_engagement, 1) AS surge FROM r)
SELECT hour, number, posts, score, old_score, round(engagement, 4) AS engagement, round(old_engagement, 4) AS old_engagement, new_bots, new_terms, CASE WHEN bots THEN 'NEW_BOTS' WHEN spike THEN 'CIB_SPIKE' WHEN terms THEN 'NARRATIVE_PIVOT' WHEN surge THEN 'ENGAGEMENT_SURGE' END AS alert,
 CASE WHEN NOT (bots OR spike OR terms OR surge) THEN NULL WHEN spike AND score >= 80 THEN 'CRITICAL' WHEN NOT spike AND new_bots >= 10 THEN 'CRITICAL' WHEN spike OR bots THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM f""")
def monitor_cycles(spark, sf_dir):
    """All events as one campaign's stream in cycles of an hour: threads are the terms, actors of errors the suspects. The last
    hours stay open, as nothing later closes them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    c = tables.as_comments(e)
    risk = F.when(F.col("action") == "error", 90.0).otherwise(0.0)
    posts = c.select(F.lit("events").alias("campaign"), F.timestamp_micros("us").alias("ts"), "author", F.col("url").alias("text"), F.col("likes").cast("double").alias("engagement"), risk.alias("risk"), F.least(F.col("likes"), F.lit(100)).cast("double").alias("score"))
    r = stored_stream(cycles.cycles(posts, 3600, "1 second"))
    return r.select(F.floor(F.unix_seconds("cycle") / 3600 - 1).alias("hour"), "number", "posts", "score", "old_score", F.round("engagement", 4).alias("engagement"), F.round("old_engagement", 4).alias("old_engagement"), "new_bots", "new_terms", "alert", "severity")


@query("monitor_summary", "SELECT count(*) AS cycles, sum(posts)::BIGINT AS posts, count(alert) AS alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, round_even(max(score), 1) AS most_score, max(hour) FILTER (alert IS NOT NULL) AS last_alert FROM (" + ORACLES["monitor_cycles"] + ")")
def monitor_summary(spark, sf_dir):
    return reports.monitor_summary(monitor_cycles(spark, sf_dir), "hour")


@query("cluster_terms", "WITH w AS (" + ORACLES["tfidf_terms"] + """), d AS (SELECT doc_id, coalesce(lang, '?') AS cluster FROM documents), n AS (SELECT cluster, count(*) AS docs FROM d GROUP BY 1),
m AS (SELECT cluster, term, round_even(sum(weight) / any_value(docs), 6) AS mean FROM w JOIN d USING (doc_id) JOIN n USING (cluster) GROUP BY 1, 2) SELECT cluster, term, mean FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, term) <= 8""")
def cluster_terms(spark, sf_dir):
    """The terms of highest mean weight of the documents of every language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("?")).alias("cluster"))
    return text.centroid_terms(tfidf_terms(spark, sf_dir), d, "doc_id")


@query("session_rows", "SELECT source AS session_id, 'all' AS queries, 'table' AS mode, '2026-01-01T00:00:00' AS timestamp, 7::INT AS days, count(*) AS post_count, count(*) FILTER (lang IN ('de', 'fr')) AS neg_count FROM documents GROUP BY source")
def session_rows(spark, sf_dir):
    """A session for every source, appended to a table of sessions."""
    label = F.when(F.col("lang") == "de", "NEGATIVE").when(F.col("lang") == "fr", "AGGRESSIVE").otherwise("NEUTRAL")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("session_id"), label.alias("label"))
    rows = sessions.session_rows(d, ["session_id"], ["all"], "table", 7, "2026-01-01T00:00:00")
    return sessions.last_sessions(rows, ["session_id"]).withColumn("queries", F.array_join("queries", ","))
