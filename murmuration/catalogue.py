"""Queries over the driver's tables and the SQL that gives the same rows.

Every callable takes (spark, sf_dir) and reads whole tables. SQL is DuckDB's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.functions import parse, text as txt
from murmuration.functions import entities
from murmuration.operators import actors, graph, models, posts, registry, reports, risk, text, timing
from murmuration.plans import paths
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables
from murmuration.streaming import monitor

QUERIES: dict = {}
ORACLES: dict = {}
HOUR = 3_600_000_000
KINDS = ["click", "error", "purchase", "signup", "view"]

C = """WITH c AS (SELECT event_type || '#' || json_extract_string(props, '$.k') AS url, event_id AS pos, user_id::VARCHAR AS author,
  epoch_us(ts) AS us, trunc(value)::INT AS likes, event_type AS source, event_type AS action FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{C}", C)
        return f

    return add


# --- actors


@query("actor_velocity", """{C}, p AS (SELECT author, count(*) AS n_comments, count(DISTINCT url) AS n_posts, (max(us) - min(us)) / 3600000000.0::DOUBLE AS span_h FROM c GROUP BY author HAVING count(*) >= 2),
v AS (SELECT *, round_even(n_comments / greatest(span_h, 0.25), 2) AS cph FROM p)
SELECT author, n_comments, n_posts, round_even(span_h, 4) AS span_h, cph, CASE WHEN cph >= 15 THEN 'BOT_VELOCITY' WHEN cph >= 7 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS velocity_label,
 CASE WHEN cph >= 15 THEN least(100, trunc(60 + (cph - 15) * 2)) WHEN cph >= 7 THEN trunc(30 + (cph - 7) * 30 / 8) ELSE trunc(cph * 30 / 7) END::INT AS velocity_score FROM v""")
def actor_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actors.velocity(tables.events(spark, sf_dir))


@query("velocity_campaign", """{C}, p AS (SELECT author, round_even(count(*) / greatest((max(us) - min(us)) / 3600000000.0::DOUBLE, 0.25), 2) AS cph FROM c GROUP BY author HAVING count(*) >= 2),
a AS (SELECT count(*) AS actors, count(*) FILTER (cph >= 15) AS bots, count(*) FILTER (cph >= 7 AND cph < 15) AS suspicious, coalesce(max(cph), 0) AS max_cph FROM p)
SELECT *, round_even(least(100, CASE WHEN actors > 0 THEN 60 * bots / actors ELSE 0 END + least(40, 1.5 * max_cph)), 1) AS score FROM a""")
def velocity_campaign(spark, sf_dir):
    return actors.velocity_campaign(actor_velocity(spark, sf_dir))


@query("actor_lifecycle", """{C}, f AS (SELECT *, min(us) OVER (PARTITION BY author) AS first, min(us) OVER () AS start_us FROM c),
p AS (SELECT author, count(*) AS n_comments, count(DISTINCT url) AS n_posts, min(us) AS first_us, count(*) FILTER (us <= first + 1800000000) AS burst,
  (min(us) - min(start_us)) / 3600000000.0::DOUBLE AS lag_h, (max(us) - min(us)) / 3600000000.0::DOUBLE AS active_h FROM f GROUP BY author HAVING count(*) >= 3),
q AS (SELECT *, n_comments / greatest(active_h, 0.5) AS cph FROM p),
r AS (SELECT *, least(100, CASE WHEN lag_h >= 0 AND lag_h < 2 THEN 30 ELSE 0 END + CASE WHEN burst >= 3 THEN 20 ELSE 0 END + CASE WHEN cph >= 10 THEN 25 ELSE 0 END
  + CASE WHEN n_posts = 1 AND n_comments >= 5 THEN 15 ELSE 0 END + CASE WHEN active_h > 0 AND active_h < 0.5 THEN 10 ELSE 0 END) AS points FROM q)
SELECT author, n_comments, n_posts, burst, round_even(lag_h, 3) AS lag_h, round_even(cph, 3) AS cph, points,
 CASE WHEN points >= 75 THEN 'SLEEPER' WHEN cph >= 10 AND points >= 40 THEN 'BURST' WHEN n_posts >= 3 AND points >= 35 THEN 'COORDINATOR' ELSE 'ORGANIC' END AS role, first_us FROM r""")
def actor_lifecycle(spark, sf_dir):
    return actors.lifecycle(tables.events(spark, sf_dir))


MOVERS = """{C}, m AS (SELECT url, author, us, place FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us, pos) AS place, count(*) OVER (PARTITION BY url) AS n FROM c) WHERE place <= 5 AND n >= 5)"""


@query("first_movers", MOVERS + " SELECT url, author, us, place::INT AS place FROM m")
def first_movers(spark, sf_dir):
    return actors.first_movers(tables.events(spark, sf_dir))


@query("seed_profiles", MOVERS + " SELECT author, count(DISTINCT url) AS posts, round_even(avg(place), 2) AS mean_place, count(DISTINCT url) >= 3 AS is_seed FROM m GROUP BY author")
def seed_profiles(spark, sf_dir):
    return actors.seed_profiles(first_movers(spark, sf_dir))


PAIRS = MOVERS + """, d AS (SELECT DISTINCT url, author FROM m), s AS (SELECT x.author AS a, y.author AS b, count(*) AS posts FROM d x JOIN d y ON x.url = y.url AND x.author < y.author GROUP BY ALL HAVING count(*) >= 2)"""


@query("seed_pairs", PAIRS + " SELECT * FROM s")
def seed_pairs(spark, sf_dir):
    return actors.seed_pairs(first_movers(spark, sf_dir))


@query("seed_teams")
def seed_teams(spark, sf_dir):
    from murmuration.plans.kernels import merge_pairs

    return merge_pairs(seed_pairs(spark, sf_dir))


@query("sleeper_cells")
def sleeper_cells(spark, sf_dir):
    return actors.sleeper_cells(actors.lifecycle(tables.events(spark, sf_dir)).filter("role = 'SLEEPER'"))


@query("style_features", r"""WITH t AS (SELECT source || '/' || lang AS author, coalesce(text, '') AS text FROM documents WHERE length(trim(coalesce(text, ''))) > 0),
w AS (SELECT author, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM t),
n AS (SELECT author, count(*) AS texts, sum(len(ws)) AS n_words, sum(length(text)) AS n_chars, sum(len(regexp_extract_all(text, '[.,;:!?]'))) AS marks, sum(len(regexp_extract_all(text, '\p{Lu}'))) AS capitals,
  sum(len(regexp_extract_all(text, '[àáâãäåèéêëìíîïòóôõöùúûüçñÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑ]'))) AS accents, sum(len(regexp_extract_all(text, '!'))) AS excl, sum(len(regexp_extract_all(text, '\?'))) AS quest, sum(len(regexp_extract_all(text, '\.\.\.'))) AS dots FROM w GROUP BY author),
d AS (SELECT author, count(DISTINCT u) AS distinct_words FROM (SELECT author, unnest(ws) AS u FROM w) GROUP BY author)
SELECT author, texts, round_even(n_words / texts::DOUBLE, 4) AS mean_words, round_even(n_chars / texts::DOUBLE, 4) AS mean_chars, round_even(marks / greatest(n_chars, 1)::DOUBLE, 4) AS mark_rate, round_even(capitals / greatest(n_chars, 1)::DOUBLE, 4) AS capital_rate,
 round_even(accents / greatest(n_chars, 1)::DOUBLE, 4) AS accent_rate, round_even(excl / texts::DOUBLE, 4) AS excl_rate, round_even(quest / texts::DOUBLE, 4) AS quest_rate, round_even(dots / texts::DOUBLE, 4) AS dots_rate,
 round_even(coalesce(distinct_words, 0) / greatest(n_words, 1)::DOUBLE, 4) AS vocab_ratio FROM n LEFT JOIN d USING (author)""")
def style_features(spark, sf_dir):
    return actors.style_features(tables.documents(spark, sf_dir))


@query("template_actors")
def template_actors(spark, sf_dir):
    return actors.template_actors(style_features(spark, sf_dir))


@query("copy_paste_groups", """WITH t AS (SELECT source || '/' || lang AS author, doc_id, substring(lower(trim(coalesce(text, ''))), 1, 30) AS opening FROM documents)
SELECT opening, count(*) AS n, count(DISTINCT author) AS actors, count(DISTINCT doc_id) AS posts FROM t WHERE length(opening) >= 30 GROUP BY opening HAVING count(DISTINCT author) >= 3""")
def copy_paste_groups(spark, sf_dir):
    return actors.copy_paste_groups(tables.documents(spark, sf_dir))


@query("name_scores", r"""WITH n AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part UNION SELECT substring(coalesce(text, ''), 1, 14) FROM documents),
t AS (SELECT name, regexp_replace(name, '^\s+|\s+$', '', 'g') AS t FROM n), w AS (SELECT *, lower(t) AS low, replace(t, ' ', '') AS solid, list_filter(string_split_regex(lower(t), '\s+'), lambda x: regexp_full_match(x, '\p{L}+')) AS ws FROM t)
SELECT name, least(100, CASE WHEN regexp_matches(t, '\d{3,}') THEN 35 ELSE 0 END + CASE WHEN t = upper(t) AND length(t) > 3 THEN 25 ELSE 0 END + CASE WHEN length(solid) <= 4 THEN 20 ELSE 0 END
 + CASE WHEN regexp_full_match(solid, '\d+') THEN 60 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '[^\p{L}\p{N}_\s,.]')) >= 2 THEN 20 ELSE 0 END + CASE WHEN len(ws) >= 2 AND len(list_distinct(ws)) < len(ws) THEN 20 ELSE 0 END
 + CASE WHEN len(ws) = 1 AND ws[1] IN ('the', 'ring') THEN 30 ELSE 0 END + CASE WHEN contains(low, 'bot') OR contains(low, 'customer') THEN 40 ELSE 0 END)::INT AS name_score FROM w""")
def name_scores(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    names = read("customer").select(F.col("c_name").alias("name")).union(read("part").select("p_name")).union(read("documents").select(F.substring(F.coalesce("text", F.lit("")), 1, 14))).distinct()
    return names.select("name", actors.name_score(F.col("name"), ["the", "ring"], ["bot", "customer"]).cast("int").alias("name_score"))


@query("human_confidence", """{C}, p AS (SELECT author, count(*) AS degree, count(*) FILTER (action = 'error') / count(*)::DOUBLE AS attack_ratio, count(DISTINCT url) / count(*)::DOUBLE AS vocab_ratio FROM c GROUP BY author),
h AS (SELECT *, greatest(0, 99 - least(floor(20 * 25 / 100.0), 25) - least(floor(attack_ratio * 25), 25) - least(floor(20 * (1 - vocab_ratio)), 20) - floor(20 * degree / greatest(max(degree) OVER (), 1)) - 0)::INT AS hcs FROM p)
SELECT author, hcs, CASE WHEN hcs >= 80 THEN 'HUMAN' WHEN hcs >= 60 THEN 'LIKELY_HUMAN' WHEN hcs >= 40 THEN 'REVIEW' WHEN hcs >= 20 THEN 'LIKELY_BOT' ELSE 'BOT' END AS hcs_band FROM h""")
def human_confidence(spark, sf_dir):
    c = tables.events(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("degree"), (F.count_if(F.col("action") == "error") / F.count(F.lit(1))).alias("attack_ratio"), (F.count_distinct("url") / F.count(F.lit(1))).alias("vocab_ratio"))
    return actors.human_confidence(c.withColumn("name_points", F.lit(20)).withColumn("pattern", F.lit(0))).select("author", "hcs", "hcs_band")


# --- time


@query("hourly_timeline", """{C} SELECT us // 3600000000 AS hour, count(*) AS n, count(DISTINCT author) AS actors FROM c GROUP BY 1 ORDER BY 1 DESC LIMIT 168""")
def hourly_timeline(spark, sf_dir):
    return timing.hourly_timeline(tables.events(spark, sf_dir))


@query("label_pivot_by_day", "{C} SELECT us // 86400000000 AS day, " + ", ".join(f"count(*) FILTER (source = '{k}') AS n_{k}" for k in KINDS) + " FROM c GROUP BY 1")
def label_pivot_by_day(spark, sf_dir):
    return timing.label_pivot(tables.events(spark, sf_dir), KINDS)


@query("peak_density", """{C}, d AS (SELECT url, us, count(*) OVER (PARTITION BY url ORDER BY us RANGE BETWEEN CURRENT ROW AND 36000000000 FOLLOWING) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, us) AS r FROM d) SELECT url, n AS peak, us AS peak_us FROM r WHERE r = 1""")
def peak_density(spark, sf_dir):
    return timing.peak_density(tables.events(spark, sf_dir), 36_000)


@query("attack_waves")
def attack_waves(spark, sf_dir):
    return timing.attack_waves(tables.events(spark, sf_dir), 60)


@query("wave_actors")
def wave_actors(spark, sf_dir):
    return timing.wave_actors(attack_waves(spark, sf_dir))


@query("temporal_campaign")
def temporal_campaign(spark, sf_dir):
    return timing.temporal_campaign(attack_waves(spark, sf_dir), sync_pairs(spark, sf_dir))


SYNC = """SELECT least(x.author, y.author) AS a, greatest(x.author, y.author) AS b, count(*) AS times, count(DISTINCT x.url) AS posts, min(y.us - x.us) AS least_gap_us
FROM c x JOIN c y ON x.author <> y.author AND y.us - x.us BETWEEN 0 AND {W} AND (x.us < y.us OR x.pos < y.pos) {K} GROUP BY 1, 2"""


@query("sync_pairs", "{C} " + SYNC.replace("{W}", "3000000").replace("{K}", ""))
def sync_pairs(spark, sf_dir):
    return timing.sync_pairs(tables.events(spark, sf_dir))


@query("thread_sync_pairs", "{C} " + SYNC.replace("{W}", "600000000").replace("{K}", "AND x.url = y.url"))
def thread_sync_pairs(spark, sf_dir):
    return timing.sync_pairs(tables.events(spark, sf_dir), 600, same_post=True)


@query("elapsed_bins", """{C}, t AS (SELECT *, us - min(us) OVER (PARTITION BY url) AS age FROM c)
SELECT url, CASE WHEN age < 7200000000 THEN 0 WHEN age < 21600000000 THEN 1 WHEN age < 86400000000 THEN 2 ELSE 3 END AS slot, count(*) AS n, sum(likes)::BIGINT AS likes FROM t GROUP BY 1, 2""")
def elapsed_bins(spark, sf_dir):
    return timing.elapsed_bins(tables.events(spark, sf_dir))


VOTE = "CASE WHEN action = 'error' THEN -1 WHEN action = 'purchase' THEN 1 ELSE 0 END"


@query("sentiment_delta", """{C}, t AS (SELECT *, us - min(us) OVER (PARTITION BY url) AS age, (likes < 100)::INT::DOUBLE AS neg FROM c),
p AS (SELECT url, count(*) FILTER (age < 7200000000) AS n_early, count(*) FILTER (age >= 21600000000) AS n_late, round_even(coalesce(avg(neg) FILTER (age < 7200000000), 0) - coalesce(avg(neg) FILTER (age >= 21600000000), 0), 4) AS delta FROM t GROUP BY url)
SELECT *, CASE WHEN n_early < 3 THEN 'INSUFFICIENT' WHEN delta >= 0.20 THEN 'SEEDED' WHEN delta <= -0.20 THEN 'REVERSED' ELSE 'STABLE' END AS delta_label FROM p""")
def sentiment_delta(spark, sf_dir):
    return timing.sentiment_delta(tables.events(spark, sf_dir).withColumn("vote", F.when(F.col("likes") < 100, -1).otherwise(1)))


@query("cohort_shift", """{C}, s AS (SELECT (us - min(us) OVER ()) // 3600000000 AS cohort, author FROM c), m0 AS (SELECT DISTINCT cohort, author FROM s),
b AS (SELECT author FROM c GROUP BY author HAVING count(*) FILTER (action = 'error') * 5 >= count(*)),
m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cohort) AS size FROM m0) WHERE size >= 3), z AS (SELECT cohort, max(size) AS size, round_even(count(*) FILTER (author IN (SELECT author FROM b)) / max(size)::DOUBLE, 4) AS bots FROM m GROUP BY 1),
p AS (SELECT * FROM (SELECT *, lead(cohort) OVER (ORDER BY cohort) AS next, lead(size) OVER (ORDER BY cohort) AS next_size, lead(bots) OVER (ORDER BY cohort) AS next_bots FROM z) WHERE next IS NOT NULL),
q AS (SELECT p.*, (SELECT count(*) FROM m x JOIN m y ON x.author = y.author WHERE x.cohort = p.cohort AND y.cohort = p.next) AS shared FROM p),
r AS (SELECT *, round_even(shared / (size + next_size - shared)::DOUBLE, 4) AS jaccard, round_even(1 - shared / next_size::DOUBLE, 4) AS turnover FROM q)
SELECT cohort, next, size, next_size, shared, jaccard, turnover, bots, next_bots, CASE WHEN jaccard <= 0.15 AND bots >= 0.40 AND next_bots >= 0.40 THEN 'HIGH' WHEN jaccard <= 0.30 AND (bots >= 0.40 OR next_bots >= 0.40) THEN 'MEDIUM' WHEN jaccard <= 0.30 THEN 'LOW' ELSE 'NONE' END AS shift FROM r""")
def cohort_shift(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    bots = c.groupBy("author").agg(F.count_if(F.col("action") == "error").alias("e"), F.count(F.lit(1)).alias("n")).filter(F.col("e") * 5 >= F.col("n"))
    return timing.cohort_shifts(timing.cohorts(c), bots)


@query("contagion_windows", """{C}, d AS (SELECT url, us, count(*) OVER (PARTITION BY url ORDER BY us RANGE BETWEEN CURRENT ROW AND 900000000 FOLLOWING) AS n FROM c),
a AS (SELECT url, us AS t0 FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, us) AS r FROM d) WHERE r = 1),
w AS (SELECT c.url, likes::DOUBLE AS tone, CASE WHEN us - t0 >= -3600000000 AND us < t0 THEN 'pre' WHEN us >= t0 AND us - t0 <= 1800000000 THEN 'during' WHEN us - t0 > 1800000000 AND us - t0 <= 7200000000 THEN 'post' END AS slot FROM c JOIN a USING (url)),
p AS (SELECT url, count(slot) AS n, avg(tone) FILTER (slot = 'pre') AS pre, avg(tone) FILTER (slot = 'during') AS during, avg(tone) FILTER (slot = 'post') AS post FROM w GROUP BY url),
s AS (SELECT *, round_even(coalesce(post - pre, during - pre, during), 4) AS shift FROM p)
SELECT url, n, round_even(pre, 4) AS pre, round_even(during, 4) AS during, round_even(post, 4) AS post, shift, coalesce(abs(shift) >= 0.15, false) AS confirmed FROM s""")
def contagion_windows(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    return timing.contagion(c.withColumn("tone", F.col("likes")), timing.arrivals(c))


@query("reply_interval", """{C}, b AS (SELECT author FROM c GROUP BY author HAVING count(*) FILTER (action = 'error') * 4 >= count(*)),
x AS (SELECT o.url, o.author, o.us, count(DISTINCT r.author) AS bots, min(r.us - o.us) AS least_us FROM c o JOIN c r ON o.url = r.url AND r.us > o.us AND r.us <= o.us + 86400000000
  WHERE o.author NOT IN (SELECT author FROM b) AND r.author IN (SELECT author FROM b) GROUP BY ALL) SELECT * FROM x WHERE bots >= 2""")
def reply_interval(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    bots = c.groupBy("author").agg(F.count_if(F.col("action") == "error").alias("e"), F.count(F.lit(1)).alias("n")).filter(F.col("e") * 4 >= F.col("n"))
    return timing.reply_intervals(c, bots, 86_400)


@query("tag_adoption", """{C}, g AS (SELECT url AS tag, count(*) AS uses, count(DISTINCT author) AS actors FROM c GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT author) >= 2),
h AS (SELECT url AS tag, us // 3600000000 AS hour, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT tag, arg_min(n, hour) AS first_hour, max(n) AS peak_hour, count(*) AS hours FROM h GROUP BY 1),
f AS (SELECT url AS tag, count(DISTINCT author) AS seeders FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us, pos) AS r FROM c) WHERE r <= 3 GROUP BY 1),
p AS (SELECT *, round_even(peak_hour / greatest(first_hour, 1)::DOUBLE, 3) AS rate FROM g JOIN s USING (tag) JOIN f USING (tag))
SELECT tag, uses, actors, first_hour, peak_hour, hours, seeders, rate, CASE WHEN rate >= 3 THEN 'RAPID_SEEDING' WHEN rate >= 1.8 THEN 'AMPLIFIED' ELSE 'ORGANIC' END AS tag_label FROM p""")
def tag_adoption(spark, sf_dir):
    return timing.tag_adoption(tables.events(spark, sf_dir).withColumn("tag", F.col("url")))


@query("narrative_mutation")
def narrative_mutation(spark, sf_dir):
    w = timing.sliding_windows(tables.events(spark, sf_dir), 24 * 60, 12 * 60)
    return timing.narrative_mutations(w.select("window", F.col("pos").alias("doc"), F.col("url").alias("term")))


@query("sliding_counts", """{C}, s AS (SELECT us - min(us) OVER () AS d, author FROM c), w AS (SELECT unnest(range(greatest(0, ((d - 21600000000) // 10800000000) + 1 - CASE WHEN (d - 21600000000) < 0 AND (d - 21600000000) % 10800000000 <> 0 THEN 1 ELSE 0 END), d // 10800000000 + 1)) AS k, author FROM s)
SELECT k AS window_id, count(*) AS n, count(DISTINCT author) AS actors FROM w GROUP BY 1""")
def sliding_counts(spark, sf_dir):
    w = timing.sliding_windows(tables.events(spark, sf_dir), 360, 180)
    return w.groupBy(F.col("window").alias("window_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("actors"))


@query("watermarked_tumbling", """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def watermarked_tumbling(spark, sf_dir):
    t = monitor.tumbling_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return t.select(tables.micros(F.col("w.start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n")


@query("session_windows", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    t = monitor.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), gap="6 hours")
    at = lambda c: tables.micros(F.col(c).cast("timestamp_ntz"))
    return t.select("user_id", at("s.start").alias("start_us"), at("s.end").alias("end_us"), "n")


# --- posts

POSTS = """p AS (SELECT json_extract_string(props, '$.k') AS url, min(event_id) AS pos, arg_min(event_type, event_id) AS source, min(epoch_us(ts)) AS us, count(*) FILTER (event_type IN ('click', 'view')) AS reactions,
  count(*) FILTER (event_type IN ('error', 'purchase')) AS comments_count, count(*) FILTER (event_type = 'signup') AS shares FROM events GROUP BY 1)"""


@query("engagement_anomaly", "WITH " + POSTS + """, r AS (SELECT *, reactions / greatest(comments_count, 1)::DOUBLE AS ratio FROM p WHERE reactions >= 5), b AS (SELECT median(ratio) AS base FROM r),
l AS (SELECT r.*, CASE WHEN reactions >= 20 AND comments_count <= 2 AND shares <= 2 THEN 'GHOST' WHEN ratio >= 10 AND shares / reactions::DOUBLE >= 0.15 THEN 'AMPLIFIED' WHEN ratio >= 10 THEN 'BOT_BOOSTED' WHEN ratio >= 5 THEN 'SUSPICIOUS' ELSE 'ORGANIC' END AS anomaly,
  round_even(100 * (ratio - base) / greatest(base, 0.01), 2) AS deviation FROM r, b)
SELECT url, reactions, comments_count, shares, round_even(ratio, 4) AS ratio, anomaly, deviation, CASE anomaly WHEN 'GHOST' THEN 100 WHEN 'BOT_BOOSTED' THEN least(90, trunc(40 + 0.3 * greatest(deviation, 0))) WHEN 'AMPLIFIED' THEN least(50, trunc(0.35 * greatest(deviation, 0)))
  WHEN 'SUSPICIOUS' THEN least(40, trunc(0.4 * greatest(deviation, 0))) ELSE 0 END::INT AS anomaly_score FROM l""")
def engagement_anomaly(spark, sf_dir):
    return posts.engagement_anomaly(tables.thread_posts(spark, sf_dir))


@query("dark_amplification", "WITH " + POSTS + """, n AS (SELECT max(epoch_us(ts)) AS now FROM events), e AS (SELECT p.*, reactions + comments_count + shares AS engagement, greatest((now - us) / 3600000000.0::DOUBLE, 0.1) AS age_h FROM p, n),
v AS (SELECT *, engagement / age_h AS velocity FROM e WHERE engagement >= 5 AND age_h >= 0.5), f AS (SELECT v.*, velocity / greatest((SELECT median(velocity) FROM v), 1e-9) AS factor FROM v),
l AS (SELECT *, CASE WHEN factor >= 5 AND (comments_count >= 0.15 * engagement OR shares >= 0.05 * engagement) THEN 'VIRAL_GENUINE' WHEN factor >= 5 THEN 'DARK_AMP' ELSE 'ORGANIC' END AS amplification FROM f)
SELECT url, engagement, round_even(age_h, 3) AS age_h, round_even(velocity, 3) AS velocity, round_even(factor, 3) AS factor, amplification,
 CASE amplification WHEN 'ORGANIC' THEN 0 WHEN 'VIRAL_GENUINE' THEN greatest(5, trunc(4 * factor)) ELSE least(100, least(60, trunc(6 * factor))) END::INT AS amplification_score FROM l""")
def dark_amplification(spark, sf_dir):
    now = tables.events(spark, sf_dir).agg(F.max("us")).first()[0]
    return posts.dark_amplification(tables.thread_posts(spark, sf_dir), F.lit(now), 5)


CORR = """{C}, m AS (SELECT DISTINCT url, author FROM c), z AS (SELECT url, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT x.url AS a, y.url AS b, count(*) AS shared FROM m x JOIN m y ON x.author = y.author AND x.url < y.url GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT a, b, shared, za.n AS size_a, zb.n AS size_b, round_even(shared / (za.n + zb.n - shared)::DOUBLE, 4) AS jaccard FROM s JOIN z za ON za.url = a JOIN z zb ON zb.url = b),
l AS (SELECT *, CASE WHEN jaccard >= 0.35 THEN 'HIGH' WHEN jaccard >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM j)"""


@query("thread_correlation", CORR + " SELECT * FROM l")
def thread_correlation(spark, sf_dir):
    return posts.post_correlation(tables.events(spark, sf_dir))


@query("correlation_campaign", CORR + """, g AS (SELECT count(*) AS pairs, count(*) FILTER (level = 'HIGH') AS high, coalesce(avg(jaccard), 0) AS mean FROM l)
SELECT pairs, high, round_even(mean, 6) AS mean_jaccard, round_even(least(100, CASE WHEN pairs > 0 THEN 70 * high / pairs::DOUBLE ELSE 0 END + least(30, 50 * mean)), 1) AS score FROM g""")
def correlation_campaign(spark, sf_dir):
    return posts.correlation_campaign(thread_correlation(spark, sf_dir)).withColumn("mean_jaccard", F.bround("mean_jaccard", 6))


@query("source_overlap", """{C}, m AS (SELECT DISTINCT source, author FROM c), z AS (SELECT source, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT x.source AS a, y.source AS b, x.n AS size_a, y.n AS size_b, (SELECT count(*) FROM m u JOIN m w ON u.author = w.author WHERE u.source = x.source AND w.source = y.source) AS shared FROM z x JOIN z y ON x.source < y.source),
j AS (SELECT *, round_even(shared / (size_a + size_b - shared)::DOUBLE, 4) AS jaccard FROM p)
SELECT *, CASE WHEN jaccard >= 0.30 THEN 'HIGH' WHEN jaccard >= 0.15 THEN 'MEDIUM' WHEN jaccard >= 0.05 THEN 'LOW' ELSE 'NONE' END AS level FROM j""")
def source_overlap(spark, sf_dir):
    return posts.source_overlap(tables.events(spark, sf_dir))


@query("multi_source_actors", "{C} SELECT author, count(DISTINCT source) AS sources, count(DISTINCT url) AS posts, count(*) AS comments FROM c GROUP BY author HAVING count(DISTINCT source) >= 2")
def multi_source_actors(spark, sf_dir):
    return posts.multi_source_actors(tables.events(spark, sf_dir))


@query("bipartite_attribution", """WITH m AS (SELECT DISTINCT l_suppkey AS l, l_partkey AS r, l_orderkey AS v FROM lineitem), o AS (SELECT l, count(DISTINCT v) AS n FROM m GROUP BY 1),
p AS (SELECT l, r, count(*) AS met FROM m GROUP BY 1, 2 HAVING count(*) >= 2), q AS (SELECT p.*, met / n::DOUBLE AS ex FROM p JOIN o USING (l)), k AS (SELECT *, round_even(least(100, met * 5) / 2.0::DOUBLE + 50 * ex, 2) AS confidence FROM q)
SELECT l, r, met, round_even(ex, 4) AS exclusivity, confidence, CASE WHEN confidence >= 70 THEN 'CONFIRMED' WHEN confidence >= 40 THEN 'PROBABLE' ELSE 'POSSIBLE' END AS attribution FROM k""")
def bipartite_attribution(spark, sf_dir):
    return posts.bipartite_attribution(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_partkey", "l_orderkey")


@query("page_jaccard", """WITH m AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS x FROM lineitem), z AS (SELECT p, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT u.p AS a, w.p AS b, count(*) AS shared FROM m u JOIN m w ON u.x = w.x AND u.p < w.p GROUP BY 1, 2 HAVING count(*) >= 2),
j AS (SELECT a, b, shared, za.n AS size_a, zb.n AS size_b, round_even(shared / (za.n + zb.n - shared)::DOUBLE, 4) AS jaccard FROM s JOIN z za ON za.p = a JOIN z zb ON zb.p = b)
SELECT *, CASE WHEN jaccard >= 0.60 AND shared >= 5 THEN 'CONFIRMED' WHEN jaccard >= 0.35 AND shared >= 3 THEN 'PROBABLE' WHEN jaccard >= 0.20 THEN 'SUSPECTED' ELSE 'LOW' END AS risk,
 greatest(1, least(99, trunc(40 * jaccard + 30 * least(shared / 10.0::DOUBLE, 1))))::INT AS confidence FROM j""")
def page_jaccard(spark, sf_dir):
    return posts.page_ownership(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("author")))


@query("attack_sources", """WITH d AS (SELECT source, n_chars AS reactions, lang <> 'en' AS attack FROM documents)
SELECT source, count(*) AS posts, count(*) FILTER (attack) AS attacks, round_even(avg(reactions), 2) AS mean_reactions FROM d GROUP BY source HAVING count(*) >= 2 AND count(*) FILTER (attack) / count(*)::DOUBLE >= 0.35""")
def attack_sources(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("n_chars").alias("reactions"), (F.col("lang") != "en").alias("attack"))
    return posts.attack_sources(d, share=0.35)


@query("top_per_source", "WITH " + POSTS + " SELECT source, url, reactions, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY reactions DESC, pos)::INT AS rank FROM p) WHERE rank <= 3")
def top_per_source(spark, sf_dir):
    return posts.top_per_source(tables.thread_posts(spark, sf_dir)).select("source", "url", "reactions", "rank")


@query("dedup_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substring(text, 1, 80) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("").alias("url"))
    return posts.dedup_posts(d, "doc_id").select("doc_id")


@query("upsert_merge", """{C} SELECT url, max(likes) AS reactions, arg_min(source, pos) AS source, min_us AS us FROM (SELECT *, first_value(us) OVER (PARTITION BY url ORDER BY pos) AS min_us FROM c) GROUP BY url, min_us""")
def upsert_merge(spark, sf_dir):
    c = tables.events(spark, sf_dir).select("url", "pos", "source", "text", "us", F.col("likes").alias("reactions"), F.lit(0).alias("comments_count"), F.lit(0).alias("shares"))
    return posts.upsert_posts(c).select("url", "reactions", "source", "us")


@query("url_clean", r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&](story_fbid|fbid|v)=[^&#]+') THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '?' || regexp_extract(url, '[?&]((?:story_fbid|fbid|v)=[^&#]+)', 1)
 ELSE regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '/+$', '') END AS url, CASE WHEN contains(lower(url), '/reel') THEN 'reel' WHEN contains(lower(url), '/video') OR contains(lower(url), '/watch') THEN 'video' WHEN contains(lower(url), '/photo') THEN 'photo' ELSE 'post' END AS post_type FROM pages""")
def url_clean(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", txt.clean_url(F.col("url")).alias("url"), txt.post_type(F.col("url")).alias("post_type"))


@query("page_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", parse.visible_text(F.col("html")).alias("text"))


# --- text


@query("near_dup_documents")
def near_dup_documents(spark, sf_dir):
    return text.near_copies(tables.documents(spark, sf_dir), "pos", "text", 0.65)


@query("bigram_jaccard")
def bigram_jaccard(spark, sf_dir):
    return text.bigram_jaccard(tables.documents(spark, sf_dir), "url", "text", 0.5)


@query("seeded_texts")
def seeded_texts(spark, sf_dir):
    c = tables.documents(spark, sf_dir)
    return text.seeded_texts(c, graph.components(text.near_copies(c, "url", "text", 0.65)), "url")


TOKENS = r"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{3,}')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)"


@query("tfidf_terms", "WITH " + TOKENS + """, d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT doc_id, sum(tf) AS len FROM f GROUP BY 1)
SELECT doc_id, term, round_even(tf / len::DOUBLE * (ln((SELECT count(DISTINCT doc_id) FROM documents) / df::DOUBLE) + 1), 6) AS weight FROM f JOIN d USING (term) JOIN s USING (doc_id)""")
def tfidf_terms(spark, sf_dir):
    return text.tfidf(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


@query("top_terms", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{4,}')) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 30")
def top_terms(spark, sf_dir):
    return text.top_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("narrative_keys", r"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{4,}')) AS term FROM documents), f AS (SELECT source, term, count(*) AS tf FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) AS r FROM f) SELECT source, string_agg(term, ' ' ORDER BY term) AS narrative FROM r WHERE r <= 20 GROUP BY 1""")
def narrative_keys(spark, sf_dir):
    k = text.narrative_key(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")
    return k.select("source", F.array_join("narrative", " ").alias("narrative"))


@query("text_clusters")
def text_clusters(spark, sf_dir):
    return text.text_clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", 0.35)


@query("lexicon_sentiment", r"""WITH l(word, polarity, score) AS (VALUES ('the', 'positive', 1.0::DOUBLE), ('and', 'negative', 2.0::DOUBLE)), w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{1,}')) AS word FROM conversations),
s AS (SELECT conv_id, turn, round_even(least(1, coalesce(sum(score) FILTER (polarity = 'negative'), 0) / 12), 3) AS negative, round_even(least(1, coalesce(sum(score) FILTER (polarity = 'positive'), 0) / 12), 3) AS positive FROM w JOIN l USING (word) GROUP BY 1, 2),
j AS (SELECT DISTINCT conv_id, turn, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive FROM conversations LEFT JOIN s USING (conv_id, turn))
SELECT *, round_even(positive - negative, 3) AS net, CASE WHEN negative >= 0.15 AND negative >= positive THEN 'NEGATIVE' WHEN positive >= 0.15 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label FROM j""")
def lexicon_sentiment(spark, sf_dir):
    lexicon = spark.createDataFrame([("the", "positive", 1.0), ("and", "negative", 2.0)], "word string, polarity string, score double")
    return text.sentiment(spark.read.parquet(f"{sf_dir}/conversations.parquet"), lexicon, ["conv_id", "turn"])


@query("vector_cosine_pairs", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL) SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.e, y.e), 4) AS cosine FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.4""")
def vector_cosine_pairs(spark, sf_dir):
    return text.vector_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.4)


@query("human_numbers", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN n // 1000 * 1000 WHEN 1 THEN 1500 WHEN 2 THEN 3200 WHEN 3 THEN n WHEN 4 THEN 2000000 WHEN 5 THEN n WHEN 6 THEN 0 ELSE 1 END AS value
FROM (SELECT o_orderkey, o_totalprice::BIGINT % 900000 + 1000 AS n FROM orders)""")
def human_numbers(spark, sf_dir):
    """Every form in which a count is written, by order key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("n", F.bround("o_totalprice").cast("long") % 900000 + 1000)
    parted = lambda mark: F.concat(F.floor(F.col("n") / 1000).cast("string"), F.lit(mark), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"))
    forms = [F.concat(F.floor(F.col("n") / 1000).cast("string"), F.lit("K")), F.lit("1,5 mil"), F.lit(" 3.2k reacciones"), parted("."), F.lit("2 millones"), parted(","), F.lit("sin datos"), F.lit("1.5")]
    shown = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select("o_orderkey", parse.human_number(shown).alias("value"))


# --- graph

EDGES = """{C}, m AS (SELECT DISTINCT url, author FROM c), e AS (SELECT x.author AS a, y.author AS b, count(*) AS posts FROM m x JOIN m y ON x.url = y.url AND x.author < y.author GROUP BY 1, 2),
w AS (SELECT *, round_even(posts / (SELECT max(posts) FROM e)::DOUBLE, 4) AS weight FROM e)"""


def _edges(spark, sf_dir):
    return graph.co_occurrence(tables.events(spark, sf_dir), None)


@query("co_occurrence_edges", EDGES + " SELECT * FROM w")
def co_occurrence_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("node_degree", EDGES + ", u AS (SELECT a AS node, weight FROM w UNION ALL SELECT b, weight FROM w) SELECT node, count(*) AS degree, round_even(sum(weight), 4) AS strength FROM u GROUP BY 1")
def node_degree(spark, sf_dir):
    return graph.degree(_edges(spark, sf_dir))


def _pagerank_sql(steps: int) -> str:
    sql = EDGES + """, u AS (SELECT a AS src, b AS dst, posts::DOUBLE AS x FROM w UNION ALL SELECT b, a, posts::DOUBLE FROM w), o AS (SELECT src, sum(x) AS t FROM u GROUP BY 1), k AS MATERIALIZED (SELECT u.src, dst, x / t AS share FROM u JOIN o ON u.src = o.src),
n AS (SELECT count(*) AS n FROM o), r0 AS (SELECT src AS node, 1.0::DOUBLE / n AS rank FROM o, n)"""
    for i in range(1, steps + 1):
        sql += f", r{i} AS MATERIALIZED (SELECT dst AS node, 0.15 / any_value(n) + 0.85 * sum(rank * share) AS rank FROM k JOIN r{i - 1} ON src = node, n GROUP BY 1)"
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{steps}"


@query("pagerank", _pagerank_sql(5))
def pagerank(spark, sf_dir):
    return graph.member_pagerank(tables.events(spark, sf_dir), 5).select("node", F.round("rank", 6).alias("rank"))


@query("gini", """{C}, v AS (SELECT count(*) AS x FROM c GROUP BY author), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM v)
SELECT round_even(2 * sum(i * x) / (count(*) * sum(x))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 4) AS gini, count(*) AS n FROM r""")
def gini(spark, sf_dir):
    return graph.gini(tables.events(spark, sf_dir).groupBy("author").count(), "count")


@query("components", """WITH RECURSIVE d AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + floor(o_totalprice)::BIGINT) % 400000 + 1000000 AS b FROM orders WHERE o_orderpriority = '1-URGENT'), e AS (SELECT a AS x, b AS y FROM d UNION SELECT b, a FROM d),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority = '1-URGENT'")
    b = (F.col("o_custkey") * 7 + F.floor("o_totalprice")) % 400000 + 1000000
    return graph.components(o.select(F.col("o_custkey").alias("a"), b.alias("b")).distinct())


@query("components_all")
def components_all(spark, sf_dir):
    """Components over all orders: customers and the values of their orders, which are negative so that they don't
    meet the customers' keys. `components` stays on the rows of its SQL."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    b = -1 - (F.col("o_custkey") * 7 + F.floor("o_totalprice"))
    return graph.components(o.select(F.col("o_custkey").alias("a"), b.alias("b")).distinct())


@query("communities")
def communities(spark, sf_dir):
    e = thread_correlation(spark, sf_dir).select("a", "b", F.col("jaccard").alias("weight"))
    return graph.label_propagation(e, 4)


@query("community_density")
def community_density(spark, sf_dir):
    e = graph.settle(thread_correlation(spark, sf_dir).select("a", "b", F.col("jaccard").alias("weight")))
    return graph.cluster_density(e, graph.label_propagation(e, 4))


@query("influence")
def influence(spark, sf_dir):
    e = graph.settle(_edges(spark, sf_dir))
    n = graph.degree(e).join(graph.pagerank(e, 10), "node").join(_betweenness(e), "node", "left").fillna(0.0, ["betweenness"])
    n = n.join(suspect_scores(spark, sf_dir).withColumnRenamed("author", "node"), "node", "left")
    return graph.influence(n).select("node", "degree", "influence")


def _betweenness(e, exact: int = 200, sample: int = 50):
    """(node, betweenness) from every node as a source up to `exact` nodes, as in the reference; above, from `sample`
    nodes by hash, scaled by nodes / sources."""
    nodes = stored(e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    n = nodes.count()
    k = n if n <= exact else min(sample, n)
    parts = paths.betweenness(e, nodes.orderBy(F.xxhash64("node"), "node").limit(k))
    return parts.withColumn("betweenness", F.round(F.col("betweenness") * (n / max(k, 1)), 4))


@query("betweenness")
def betweenness(spark, sf_dir):
    return _betweenness(stored(_edges(spark, sf_dir).select("a", "b", "weight")))


# --- models


@query("markov_transitions", """{C}, t AS (SELECT lag(action, 2) OVER w AS before2, lag(action, 1) OVER w AS before1, action FROM c WINDOW w AS (PARTITION BY author ORDER BY us, pos)) SELECT before2, before1, action, count(*) AS n FROM t WHERE before2 IS NOT NULL GROUP BY ALL""")
def markov_transitions(spark, sf_dir):
    return models.markov_transitions(tables.events(spark, sf_dir))


@query("action_loglik", """{C}, t AS (SELECT author, lag(action, 2) OVER w AS b2, lag(action, 1) OVER w AS b1, action FROM c WINDOW w AS (PARTITION BY author ORDER BY us, pos)), s AS (SELECT * FROM t WHERE b2 IS NOT NULL),
k AS (SELECT b2, b1, action, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT b2, b1, sum(n) AS m FROM k GROUP BY ALL) SELECT author, count(*) AS steps, round_even(avg(ln((n + 0.1) / (m + 0.5)::DOUBLE)), 4) AS mean_loglik FROM s JOIN k USING (b2, b1, action) JOIN a USING (b2, b1) GROUP BY 1""")
def action_loglik(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    return models.action_loglik(c, models.markov_transitions(c), len(KINDS))


@query("action_diversity", """{C}, k AS (SELECT author, action, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT *, n / (sum(n) OVER (PARTITION BY author))::DOUBLE AS q FROM k) SELECT author, sum(n)::BIGINT AS n, round_even(-sum(q * log2(q)), 4) AS entropy, count(*) AS kinds FROM p GROUP BY 1""")
def action_diversity(spark, sf_dir):
    return models.action_diversity(tables.events(spark, sf_dir))


@query("circadian", """{C}, t AS (SELECT author, (us // 3600000000) % 24 AS h FROM c), a AS (SELECT author, count(*) AS n, avg((h >= 22 OR h < 8)::INT::DOUBLE) AS share FROM t GROUP BY 1 HAVING count(*) >= 3)
SELECT author, n, round_even(share, 4) AS night_share, round_even(1 - 2 * abs(share - 1 / 3.0::DOUBLE), 4) AS circadian FROM a""")
def circadian(spark, sf_dir):
    return models.circadian(tables.events(spark, sf_dir))


@query("hawkes_fit", """{C}, g AS (SELECT author, (us - lag(us) OVER (PARTITION BY author ORDER BY us, pos)) / 1e6::DOUBLE AS gap FROM c), a AS (SELECT author, count(*) AS n, sum(gap) AS span, avg(gap) AS m, var_pop(gap) AS v FROM g GROUP BY 1 HAVING count(*) >= 3 AND sum(gap) > 0)
SELECT author, n, round_even(span, 3) AS span_s, round_even(n / span, 9) AS mu, round_even(greatest(0, least(0.9, ((v - m) / (v + m) + 1) / 2)), 6) AS alpha FROM a""")
def hawkes_fit(spark, sf_dir):
    return models.hawkes_fit(tables.events(spark, sf_dir)).select("author", "n", F.bround("span_s", 3).alias("span_s"), F.bround("mu", 9).alias("mu"), F.bround("alpha", 6).alias("alpha"))


@query("hawkes_loglik")
def hawkes_loglik(spark, sf_dir):
    return models.hawkes_loglik(tables.events(spark, sf_dir), beta=0.001)


@query("psi")
def psi(spark, sf_dir):
    return models.psi(tables.events(spark, sf_dir))


@query("character_grams")
def character_grams(spark, sf_dir):
    return models.character_grams(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query("sockpuppets")
def sockpuppets(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    p = models.style_and_hours(c.groupBy("author", F.col("url").alias("token")).agg(F.count(F.lit(1)).alias("n")), c)
    return models.sockpuppets(p, p)


@query("hour_occupancy", """{C}, h AS (SELECT DISTINCT author, ((us // 3600000000) % 24)::INT AS h FROM c), n AS (SELECT author, count(*) AS k FROM h GROUP BY 1), p AS (SELECT x.author AS a, y.author AS b, count(*) AS n_both FROM h x JOIN h y ON x.h = y.h AND x.author < y.author GROUP BY 1, 2)
SELECT a, b, n_both AS "both", round_even((na.k + nb.k - 2 * n_both) / (na.k + nb.k - n_both)::DOUBLE, 4) AS anticorrelation FROM p JOIN n na ON na.author = a JOIN n nb ON nb.author = b""")
def hour_occupancy(spark, sf_dir):
    return models.hour_occupancy(tables.events(spark, sf_dir))


# --- registry, fusion, evidence


def _seen(spark, sf_dir):
    return registry.appearances(tables.events(spark, sf_dir), F.floor(F.col("us") / (24 * HOUR)), 100.0 * F.count_if(F.col("action") == "error") / F.count(F.lit(1)))


SEEN = "{C}, s AS (SELECT us // 86400000000 AS campaign, author, count(*) AS comments, count(DISTINCT url) AS posts, 100.0::DOUBLE * count(*) FILTER (action = 'error') / count(*) AS score FROM c GROUP BY 1, 2)"


@query("registry_rollup", SEEN + """, a AS (SELECT author, avg(score) AS m, count(DISTINCT campaign) AS campaigns, sum(comments)::BIGINT AS comments, min(campaign) AS first, max(campaign) AS last, string_agg(DISTINCT campaign::VARCHAR, ',' ORDER BY campaign::VARCHAR) AS campaign_list FROM s GROUP BY 1 HAVING count(DISTINCT campaign) >= 2)
SELECT * EXCLUDE (m), round_even(m, 4) AS mean_score, CASE WHEN campaigns >= 5 THEN 'PROFESSIONAL' WHEN campaigns >= 3 THEN 'PERSISTENT' ELSE 'RECURRING' END AS career, least(100, least(50, 10 * campaigns) + least(30, floor(round_even(m, 4) * 3 / 10)) + least(20, comments // 10))::INT AS persistence FROM a""")
def registry_rollup(spark, sf_dir):
    return registry.registry_rollup(_seen(spark, sf_dir))


@query("new_in_campaign", SEEN + ", k AS (SELECT author, count(DISTINCT campaign) AS k FROM s GROUP BY 1) SELECT campaign, count(*) AS actors, count(*) FILTER (k = 1) AS only_here FROM s JOIN k USING (author) GROUP BY 1")
def new_in_campaign(spark, sf_dir):
    return registry.new_in_campaign(_seen(spark, sf_dir))


@query("session_delta", """{C}, h AS (SELECT min(us) + (max(us) - min(us)) // 2 AS mid FROM c), b AS (SELECT author, least(100, count(*))::INT AS was FROM c, h WHERE us < mid GROUP BY 1), a AS (SELECT author, least(100, count(*))::INT AS now FROM c, h WHERE us >= mid GROUP BY 1),
j AS (SELECT author, was, now, coalesce(now, 0) - coalesce(was, 0) AS delta FROM b FULL JOIN a USING (author))
SELECT *, CASE WHEN was IS NULL AND now >= 60 THEN 'NEW_BOT' WHEN now IS NULL AND was >= 60 THEN 'DISAPPEARED' WHEN was IS NULL OR now IS NULL THEN 'MINOR' WHEN delta >= 15 THEN 'SCORE_UP' WHEN delta <= -15 THEN 'SCORE_DOWN' ELSE 'STABLE' END AS status FROM j""")
def session_delta(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    r = c.agg(F.min("us"), F.max("us")).first()
    mid = r[0] + (r[1] - r[0]) // 2
    half = lambda when: c.filter(when).groupBy("author").agg(F.least(F.lit(100), F.count(F.lit(1))).cast("int").alias("score"))
    return registry.session_delta(half(F.col("us") < mid), half(F.col("us") >= mid))


@query("term_drift", r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{4,}')) AS term FROM documents), a AS (SELECT DISTINCT term FROM t WHERE lang = 'en'), b AS (SELECT DISTINCT term FROM t WHERE lang = 'fr'),
j AS (SELECT count(*) FILTER (a.term IS NOT NULL AND b.term IS NOT NULL) AS shared, count(*) FILTER (a.term IS NULL) AS gained, count(*) FILTER (b.term IS NULL) AS lost FROM a FULL JOIN b ON a.term = b.term), k AS (SELECT *, round_even(shared / greatest(shared + gained + lost, 1)::DOUBLE, 4) AS jaccard FROM j)
SELECT *, CASE WHEN jaccard >= 0.7 THEN 'STABLE' WHEN jaccard >= 0.4 THEN 'SHIFT' ELSE 'PIVOT' END AS drift FROM k""")
def term_drift(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = lambda lang: d.filter(F.col("lang") == lang).select(F.explode(txt.tokens(F.col("text"), 4)).alias("term")).distinct()
    return registry.term_drift(of("en"), of("fr"))


@query("identity_matches")
def identity_matches(spark, sf_dir):
    c = tables.events(spark, sf_dir)
    f = c.groupBy("author", "action").count().groupBy("author").pivot("action", KINDS).sum("count").fillna(0)
    f = f.select("author", F.array(*[F.col(k).cast("double") for k in KINDS]).alias("fingerprint"))
    return registry.identity_matches(f, f, 0.98)


def _scores(spark, sf_dir):
    c = tables.events(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("likes").alias("m"), F.count_distinct("author").alias("a"))
    dims = F.array(F.struct(F.lit("troll_hunter").alias("dimension"), (F.col("m") / 10).alias("score")), F.struct(F.lit("cib_graph").alias("dimension"), F.col("a").cast("double").alias("score")), F.struct(F.lit("temporal").alias("dimension"), F.lit(0.0).alias("score")))
    return c.select("source", F.explode(dims).alias("d")).select("source", "d.*")


@query("score_fusion", """{C}, s AS (SELECT source, avg(likes) / 10 AS x, count(DISTINCT author)::DOUBLE AS y FROM c GROUP BY 1), k AS (SELECT source, greatest(0, least(100, x)) AS x, greatest(0, least(100, y)) AS y FROM s),
f AS (SELECT source, round_even((x * 0.22::DOUBLE + y * 0.16::DOUBLE) / (CASE WHEN x > 0 THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN y > 0 THEN 0.16::DOUBLE ELSE 0 END) * 0.99::DOUBLE, 1) AS fused, (x > 0)::BIGINT + (y > 0)::BIGINT AS active FROM k)
SELECT source, fused, active, CASE WHEN active >= 3 THEN 'SUFFICIENT' WHEN active >= 1 THEN 'LOW' ELSE 'INSUFFICIENT' END AS quality, CASE WHEN fused >= 80 THEN 'CRITICAL' WHEN fused >= 60 THEN 'HIGH' WHEN fused >= 40 THEN 'MODERATE' WHEN fused >= 20 THEN 'LOW' ELSE 'ORGANIC' END AS label FROM f""")
def score_fusion(spark, sf_dir):
    return risk.fuse(_scores(spark, sf_dir), by=["source"])


def _signals(spark, sf_dir):
    v = actor_velocity(spark, sf_dir).select("author", F.lit("velocity").alias("signal"), (F.col("velocity_score") / 30).alias("value"))
    s = seed_profiles(spark, sf_dir).filter("is_seed").select("author", F.lit("reach").alias("signal"), F.lit(1.0).alias("value"))
    w = thread_sync_pairs(spark, sf_dir)
    w = w.select(F.explode(F.array("a", "b")).alias("author")).distinct().select("author", F.lit("wave").alias("signal"), F.lit(0.75).alias("value"))
    m = multi_source_actors(spark, sf_dir).select("author", F.lit("multi_page").alias("signal"), F.least(F.lit(1.0), F.col("sources") / 5).alias("value"))
    return v.union(s).union(w).union(m)


@query("actor_risk")
def actor_risk(spark, sf_dir):
    return risk.actor_risk(_signals(spark, sf_dir)).withColumn("signals", F.array_join("signals", ","))


@query("evidence_chain")
def evidence_chain(spark, sf_dir):
    s = _signals(spark, sf_dir).select("author", "signal", (F.col("value") * 20).cast("int").alias("points"), F.when(F.col("signal") == "wave", 1).otherwise(2).alias("severity"))
    return risk.evidence_chain(s).withColumn("chain", F.array_join("chain", ","))


MANIFEST = """{C}, i AS (SELECT 'SEED' AS category, url AS key, max(likes)::VARCHAR AS detail FROM c GROUP BY url), n AS (SELECT *, 'case-' || printf('%04d', row_number() OVER (ORDER BY category, key, detail)) AS item_id, sha256(category || '|' || key || '|' || detail) AS item_hash FROM i)"""


@query("evidence_manifest", MANIFEST + " SELECT * FROM n")
def evidence_manifest(spark, sf_dir):
    i = tables.events(spark, sf_dir).groupBy(F.col("url").alias("key")).agg(F.max("likes").cast("string").alias("detail"))
    return risk.evidence_manifest(i.select(F.lit("SEED").alias("category"), "key", "detail"), "case")


@query("manifest_hash", MANIFEST + " SELECT count(*) AS items, sha256(string_agg(item_hash, '' ORDER BY item_hash)) AS manifest_hash FROM n")
def manifest_hash(spark, sf_dir):
    return risk.manifest_hash(evidence_manifest(spark, sf_dir))


# --- reports


@query("attack_density", "{C} SELECT url, count(*) AS n, count(*) FILTER (action = 'error') AS attacks, round_even(avg((action = 'error')::INT::DOUBLE), 4) AS density FROM c GROUP BY url")
def attack_density(spark, sf_dir):
    return reports.attack_density(tables.events(spark, sf_dir), F.col("action") == "error")


@query("repeat_attackers", "{C} SELECT author, count(*) AS attacks, count(DISTINCT url) AS posts FROM c WHERE action = 'error' GROUP BY author HAVING count(DISTINCT url) >= 2")
def repeat_attackers(spark, sf_dir):
    return reports.repeat_attackers(tables.events(spark, sf_dir), F.col("action") == "error")


@query("source_totals", """SELECT source, count(*) AS posts, count(*) FILTER (lang = 'de') AS negative, count(*) FILTER (lang = 'fr') AS aggressive, sum(n_chars)::BIGINT AS engagement FROM documents GROUP BY source""")
def source_totals(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = F.when(F.col("lang") == "de", "NEGATIVE").when(F.col("lang") == "fr", "AGGRESSIVE").otherwise("NEUTRAL")
    return reports.source_totals(d.select("source", label.alias("label"), F.col("n_chars").alias("engagement")))


@query("attack_kinds", """WITH k(kind, words) AS (VALUES ('insult', ['idiot', 'moron', 'scum']), ('licence', ['licensed under', 'copyright'])), d AS (SELECT lower(coalesce(text, '')) AS t FROM documents)
SELECT kind, count(*) AS n, round_even(100 * count(*) / (SELECT count(*) FROM d)::DOUBLE, 2) AS share FROM d, k WHERE len(list_filter(words, lambda w: contains(t, w))) > 0 GROUP BY kind""")
def attack_kinds(spark, sf_dir):
    return reports.attack_kinds(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"insult": ["idiot", "moron", "scum"], "licence": ["licensed under", "copyright"]})


@query("priority_bands", """WITH d AS (SELECT round_even(100 * (0.45::DOUBLE * (lang = 'de')::INT + 0.25::DOUBLE * (lang = 'fr')::INT + 0.30::DOUBLE * least(log10(greatest(n_chars, 1)) / 4, 1)), 1) AS s FROM documents)
SELECT CASE WHEN s >= 65 THEN 'URGENT' WHEN s >= 40 THEN 'HIGH' WHEN s >= 18 THEN 'WATCH' ELSE 'LOW' END AS band, count(*) AS n, round_even(avg(s), 2) AS mean FROM d GROUP BY 1""")
def priority_bands(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = posts.priority_score((F.col("lang") == "de").cast("int"), (F.col("lang") == "fr").cast("int"), F.col("n_chars"))
    return reports.priority_bands(d.select(score.alias("score")), "score")


@query("shared_terms", r"""WITH t AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{4,}')) AS term FROM documents) SELECT term, count(*) AS sources FROM t GROUP BY 1 HAVING count(*) >= 10""")
def shared_terms(spark, sf_dir):
    return reports.shared_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), 10)


@query("weighted_mean", "SELECT l_suppkey, round_even(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS mean, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return reports.weighted_mean(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_discount", "l_quantity", ["l_suppkey"])


@query("adaptive_threshold", CORR + " SELECT count(*) AS pairs, round_even(greatest(0.05, least(0.9, avg(jaccard) + stddev_pop(jaccard))), 4) AS threshold FROM l")
def adaptive_threshold(spark, sf_dir):
    return reports.adaptive_threshold(thread_correlation(spark, sf_dir), "jaccard", low=0.05)


@query("key_figures")
def key_figures(spark, sf_dir):
    return reports.key_figures(("velocity", velocity_campaign(spark, sf_dir)), ("correlation", correlation_campaign(spark, sf_dir)), ("activity", gini(spark, sf_dir)))


@query("post_timeline")
def post_timeline(spark, sf_dir):
    e = tables.events(spark, sf_dir).withColumn("text", F.col("url"))
    return reports.post_timeline(e)


@query("page_clusters")
def page_clusters(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("author"))
    return graph.components(posts.page_ownership(m).filter("jaccard >= 0.15").select("a", "b"))


@query("comment_signals")
def comment_signals(spark, sf_dir):
    c = tables.documents(spark, sf_dir).withColumn("id", F.col("url"))
    copies = text.near_copies(c, "id", "text", 0.65)
    s = risk.comment_signals(c, copies.select(F.col("a").alias("id")).union(copies.select("b")), text.attack_predicate(F.col("text"), ["idiot", "moron", "scum"]), F.lit(0))
    return s.select("id", "points", "comment_label")


@query("post_signals")
def post_signals(spark, sf_dir):
    p = tables.documents(spark, sf_dir).select("url", "text", (F.col("likes") % 7).alias("reactions"), (F.col("likes") % 11).alias("shares"), F.lit(0).alias("comments_count"))
    copies = text.near_copies(p, "url", "text", 0.45)
    most = copies.select(F.col("a").alias("url"), F.col("jaccard").alias("most")).union(copies.select("b", "jaccard"))
    return risk.post_signals(p, most).select("url", "points", "post_label")


@query("suspect_scores", """{C}, a AS (SELECT author, count(*) FILTER (action = 'error') AS attacks, count(DISTINCT url) FILTER (action = 'error') AS posts FROM c GROUP BY 1)
SELECT author, least(99, trunc(30 * least(attacks / 20.0::DOUBLE, 1) + 40 * least(posts / 5.0::DOUBLE, 1)))::INT AS suspect_score FROM a""")
def suspect_scores(spark, sf_dir):
    a = tables.events(spark, sf_dir).groupBy("author").agg(F.count_if(F.col("action") == "error").alias("attacks"), F.count_distinct(F.when(F.col("action") == "error", F.col("url"))).alias("posts"))
    return a.select("author", risk.suspect_score(F.col("attacks"), F.col("posts"), F.lit(0), F.lit(False)).alias("suspect_score"))


@query("roles")
def roles(spark, sf_dir):
    e = graph.settle(_edges(spark, sf_dir))
    n = graph.degree(e).join(_betweenness(e), "node", "left").fillna(0.0, ["betweenness"])
    n = n.join(suspect_scores(spark, sf_dir).select(F.col("author").alias("node"), (F.col("suspect_score") >= 60).alias("suspect")), "node")
    return graph.roles(n).select("node", "degree", "suspect", "role")


@query("recurrent_actors", """{C} SELECT author, count(DISTINCT us // 86400000000) AS slices FROM c WHERE action = 'error' GROUP BY 1 HAVING count(DISTINCT us // 86400000000) >= 3""")
def recurrent_actors(spark, sf_dir):
    e = tables.events(spark, sf_dir).filter("action = 'error'").select(F.floor(F.col("us") / (24 * HOUR)).alias("slice"), "author", F.col("url").alias("community"))
    return reports.recurrent_actors(e)


@query("entity_matches", """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), m AS (SELECT doc_id, greatest(CASE WHEN contains(t, 'apache license') THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN contains(t, 'licensed') THEN 0.7::DOUBLE ELSE 0 END, 0) AS confidence FROM d) SELECT * FROM m WHERE confidence >= 0.7""")
def entity_matches(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return entities.adaptive_filter(d, ["apache license", "licensed"]).select("doc_id", "confidence")


@query("json_counts", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS value FROM events""")
def json_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", parse.deep_value(F.col("props"), "$.missing", "$.k").cast("bigint").alias("value"))


@query("deep_counts", """SELECT event_id, CASE event_type WHEN 'view' THEN greatest(k, 7) WHEN 'error' THEN 0 ELSE k END AS reactions, CASE event_type WHEN 'click' THEN k WHEN 'purchase' THEN 3 ELSE 0 END AS comments, CASE event_type WHEN 'signup' THEN k ELSE 0 END AS shares,
CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'an even longer text that stands deeper' ELSE 'a text of more than twenty' END AS message FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def deep_counts(spark, sf_dir):
    """Every kind of event as an API body of another shape: plain counts, aggregated ones, nested texts, broken JSON."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    text = '"text": "a text of more than twenty"'
    shape = lambda s: F.replace(F.lit(s), F.lit("@"), F.col("k"))
    body = (
        F.when(F.col("event_type") == "click", shape('{"a": [{"reaction_count": {"count": @}, "comments": {"total_count": @}, ' + text + "}]}"))
        .when(F.col("event_type") == "view", shape('[{"reaction_count": {"count": 7}, "b": {"c": {"cross_universe_feedback_info": {"aggregated_reaction_count": @}}}}, {"d": {' + text + ', "e": {"text": "hidden below a text and longer than all others are"}}}, {"f": [{"text": "http://example.com/a/very/long/address/that/is/no/text"}, {"text": "an even longer text that stands deeper"}]}]'))
        .when(F.col("event_type") == "signup", shape('{"reaction_count": {"count": @}, "x": {"share_count": {"count": @}}, "likers": {"count": 100000}, ' + text + "}"))
        .when(F.col("event_type") == "purchase", shape('{"reaction_count": {"count": @}, "y": [[{"cross_universe_feedback_info": {"aggregated_comment_count": 3}}]], ' + text + "}"))
        .otherwise(shape('{"reaction_count": {"count": @}'))
    )
    return entities.deep_counts(e.select("event_id", body.alias("body")), "body", ["event_id"])


@query("monitor_alerts", """{C}, h AS (SELECT *, us // 3600000000 AS hour FROM c), s AS (SELECT hour, count(*) AS engagement, least(100, 20 * count(*) FILTER (action = 'error'))::INT AS score FROM h GROUP BY 1),
b AS (SELECT DISTINCT hour, author FROM h WHERE action = 'error'), t AS (SELECT DISTINCT hour, source FROM h),
nb AS (SELECT hour, count(*) AS new_bots FROM b x WHERE NOT EXISTS (FROM b y WHERE y.hour = x.hour - 1 AND y.author = x.author) GROUP BY 1), nt AS (SELECT hour, count(*) AS new_terms FROM t x WHERE NOT EXISTS (FROM t y WHERE y.hour = x.hour - 1 AND y.source = x.source) GROUP BY 1),
j AS (SELECT a.hour, a.score, a.engagement, p.score AS ps, p.engagement AS pe, coalesce(new_bots, 0) AS new_bots, coalesce(new_terms, 0) AS new_terms FROM s a JOIN s p ON p.hour = a.hour - 1 LEFT JOIN nb ON nb.hour = a.hour LEFT JOIN nt ON nt.hour = a.hour),
f AS (SELECT *, new_bots >= 3 AS bots, score - ps >= 15 AND score >= 40 AS spike, new_terms >= 4 AS terms, engagement - pe >= 0.5::DOUBLE * greatest(pe, 1) AS surge FROM j)
SELECT hour, CASE WHEN bots THEN 'NEW_BOTS' WHEN spike THEN 'CIB_SPIKE' WHEN terms THEN 'NARRATIVE_PIVOT' WHEN surge THEN 'ENGAGEMENT_SURGE' END AS alert, CASE WHEN spike AND score >= 80 THEN 'CRITICAL' WHEN NOT spike AND new_bots >= 10 THEN 'CRITICAL' WHEN spike OR bots THEN 'HIGH' ELSE 'MEDIUM' END AS severity, score, new_bots, new_terms FROM f WHERE bots OR spike OR terms OR surge""")
def monitor_alerts(spark, sf_dir):
    """Every hour of the stream against the hour before as two cycles of the monitor."""
    c = tables.events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / HOUR))
    s = c.groupBy("hour").agg(F.count(F.lit(1)).alias("engagement"), F.least(F.lit(100), 20 * F.count_if(F.col("action") == "error")).cast("int").alias("score"))

    def fresh(rows, value, name):
        rows = rows.select("hour", value).distinct()
        return rows.join(rows.withColumn("hour", F.col("hour") + 1), ["hour", value], "left_anti").groupBy("hour").agg(F.count(F.lit(1)).alias(name))

    now = s.join(fresh(c.filter("action = 'error'"), "author", "new_bots"), "hour", "left").join(fresh(c, "source", "new_terms"), "hour", "left").fillna(0)
    return monitor.alerts(now.withColumn("hour", F.col("hour") + 1), now, by=["hour"])
