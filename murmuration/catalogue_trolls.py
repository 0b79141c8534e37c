"""Queries of actors' risk and of the chain of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.catalogue import query
from murmuration.operators import actors, identity, timing, trolls
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables

KEYWORDS = ["src1/en", "src1/fr", "src1/de", "src1/es"]
#: Words of the tables' toxic texts, in place of the reference's Spanish ones.
WORDS = "idiot|moron|scum|trash|the|of"


def _comments(spark, sf_dir):
    """Documents as comments of their source and language on the page of their language's initial and length, one every ten seconds."""
    c = tables.documents(spark, sf_dir)
    return c.withColumn("us", F.col("pos") * 10_000_000).withColumn("url", F.concat_ws("/", F.substring_index("author", "/", -1), (F.char_length("text") / 500).cast("int").cast("string")))


COMMENTS = "c AS (SELECT source || '/' || lang AS author, lang || '/' || trunc(length(text) / 500.0)::INT AS url, text, doc_id * 10000000 AS us, substring(lower(trim(text, ' ')), 1, 30) AS opening, doc_id FROM documents WHERE length(text) > 0 AND lang IS NOT NULL AND source IS NOT NULL)"
SIGNALS = "WITH " + COMMENTS + rf""", k AS (SELECT opening FROM c WHERE length(opening) >= 30 GROUP BY 1 HAVING count(DISTINCT author) >= 3), x AS (SELECT DISTINCT author FROM c JOIN k USING (opening)),
a AS (SELECT author, count(*) AS n, count(DISTINCT url) AS posts, (max(us) - min(us)) / 3.6e9::DOUBLE AS span_h, sum(regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({WORDS})([^\p{{L}}\p{{N}}_]|$)')::INT) AS insults,
  sum(regexp_matches(text, '(?i)({trolls.MEMES})')::INT) AS memes, sum(regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({WORDS})([^\p{{L}}\p{{N}}_]|$)')::INT) AS attacks FROM c GROUP BY 1),
b AS (SELECT *, least(1.0::DOUBLE, (insults + memes + attacks) / (n * 3)::DOUBLE) AS aggr, CASE WHEN n >= 2 THEN round_even(n / greatest(span_h, 0.08::DOUBLE), 2) ELSE 0 END AS cph, author IN (SELECT author FROM x) AS copied,
  CASE WHEN regexp_matches(author, '(^|[^\p{{L}}\p{{N}}_])({"|".join(KEYWORDS)})([^\p{{L}}\p{{N}}_]|$)') THEN 0.7::DOUBLE WHEN regexp_matches(author, '\d') THEN 0.15::DOUBLE ELSE 0 END AS page FROM a),
s AS (SELECT author, n, 'S2_PAGE' AS signal, page AS value, 22 AS weight, 'HIGH' AS severity FROM b WHERE page >= 0.4
  UNION ALL SELECT author, n, 'S4_AGG', aggr, 22, CASE WHEN aggr >= 0.8 THEN 'CRITICAL' WHEN aggr >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END FROM b WHERE aggr >= 0.5 OR insults + memes > 0
  UNION ALL SELECT author, n, 'S5_CROSS', least(1.0::DOUBLE, posts / 10::DOUBLE), 18, CASE WHEN posts >= 5 THEN 'CRITICAL' ELSE 'HIGH' END FROM b WHERE posts >= 3
  UNION ALL SELECT author, n, 'S6_VEL', least(1.0::DOUBLE, cph / 20), 18, CASE WHEN cph >= 15 THEN 'CRITICAL' ELSE 'HIGH' END FROM b WHERE cph >= 7
  UNION ALL SELECT author, n, 'S7_COORD', 0.85::DOUBLE, 20, 'CRITICAL' FROM b WHERE copied
  UNION ALL SELECT author, n, 'S8_PROFILE', 0.6::DOUBLE, 15, 'MEDIUM' FROM b WHERE regexp_matches(author, '\d{{2,}}') OR (NOT contains(trim(author), ' ') AND length(author) >= 5)),
p AS (SELECT author, max(n) AS comments, sum(value * weight) AS raw, count(*) FILTER (severity = 'CRITICAL') AS critical, string_agg(signal, ',' ORDER BY signal) AS signals FROM s GROUP BY 1),
r AS (SELECT author, comments, CASE WHEN critical >= 3 THEN greatest(75, least(100, round_even(round_even(raw / 170 * 100, 9), 0))) WHEN critical >= 2 THEN greatest(60, least(100, round_even(round_even(raw / 170 * 100, 9), 0))) ELSE least(100, round_even(round_even(raw / 170 * 100, 9), 0)) END::INT AS risk, critical, signals FROM p),
t AS (SELECT author, comments, risk, CASE WHEN risk >= 80 THEN 'CONFIRMED_BOT' WHEN risk >= 60 THEN 'HIGH_RISK' WHEN risk >= 40 THEN 'SUSPICIOUS' WHEN risk >= 20 THEN 'LIKELY_HUMAN' ELSE 'HUMAN' END AS classification, critical, signals FROM r)"""


def _copied(c):
    """Actors whose openings three and more actors share."""
    opening = F.substring(F.lower(F.trim("text")), 1, 30)
    shared = actors.copy_paste_groups(c).select(F.col("opening").alias("shared"))
    return c.join(shared, opening == F.col("shared"), "left_semi").select("author").distinct()


def _signals(spark, sf_dir):
    c = _comments(spark, sf_dir)
    none = c.select("author").limit(0)
    no_links = none.select(F.col("author").alias("node"), F.col("author").alias("leader"))
    return trolls.actor_signals(c, none, _copied(c), no_links, KEYWORDS, WORDS, trolls.MEMES, WORDS)


@query("actor_signals", SIGNALS + " SELECT author, signal, round(value, 6) AS value, weight, severity FROM s")
def actor_signals(spark, sf_dir):
    """Signals of every author of documents, without waves and links, which `hunted_chains` has."""
    return _signals(spark, sf_dir).select("author", "signal", F.round("value", 6).alias("value"), "weight", "severity")


@query("actor_profiles", SIGNALS + " SELECT * FROM t")
def actor_profiles(spark, sf_dir):
    return trolls.actor_profiles(_signals(spark, sf_dir))


@query("hunt_score", SIGNALS + """, z AS (SELECT * FROM t ORDER BY risk DESC, comments DESC, author LIMIT 50), y AS (SELECT count(*) AS actors, count(*) FILTER (classification = 'CONFIRMED_BOT') AS confirmed, count(*) FILTER (classification = 'HIGH_RISK') AS high_risk,
  count(*) FILTER (classification = 'SUSPICIOUS') AS suspicious, avg(risk) AS mean FROM z) SELECT actors, confirmed, high_risk, suspicious, CASE WHEN actors > 0 THEN round_even(least(100.0::DOUBLE, 60.0::DOUBLE * confirmed / actors + least(40.0::DOUBLE, 0.5 * mean)), 1) ELSE 0 END AS score FROM y""")
def hunt_score(spark, sf_dir):
    return trolls.hunt_score(actor_profiles(spark, sf_dir))


@query("name_parts", """WITH n AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT p_name FROM part), w AS (SELECT name, list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda x: len(x) > 0) AS ws FROM n),
t(part, place, label, confidence, priority) AS (VALUES ('steel', 'first', 'A', 0.9::DOUBLE, 1), ('ring', 'last', 'B', 0.8::DOUBLE, 2), ('1', 'suffix', 'C', 0.7::DOUBLE, 3), ('00', 'suffix', 'D', 0.6::DOUBLE, 3), ('customer', 'prefix', 'E', 0.5::DOUBLE, 4), ('small', 'any', 'F', 0.4::DOUBLE, 5)),
m AS (SELECT name, t.*, row_number() OVER (PARTITION BY name ORDER BY priority, length(part) DESC, part) AS r FROM w, t WHERE (place = 'first' AND ws[1] = part) OR (place = 'last' AND len(ws) > 1 AND ws[-1] = part) OR (place = 'any' AND list_contains(ws, part))
  OR (place = 'suffix' AND length(ws[-1]) > 4 AND length(ws[-1]) > length(part) AND ends_with(ws[-1], part)) OR (place = 'prefix' AND length(ws[-1]) > 4 AND length(ws[-1]) > length(part) AND starts_with(ws[-1], part)))
SELECT name, label, confidence, part AS matched FROM m WHERE r = 1""")
def name_parts(spark, sf_dir):
    """Names of customers and parts in a table of parts of names."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("author")).union(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name"))
    rows = [("steel", "first", "A", 0.9, 1), ("ring", "last", "B", 0.8, 2), ("1", "suffix", "C", 0.7, 3), ("00", "suffix", "D", 0.6, 3), ("customer", "prefix", "E", 0.5, 4), ("small", "any", "F", 0.4, 5)]
    return trolls.name_lookup(names, spark.createDataFrame(rows, "part string, place string, label string, confidence double, priority int"))


@query("hunted_chains")
def hunted_chains(spark, sf_dir):
    """Signals with waves and linked pages, and the evidence of velocity, waves, copies, confidence and returning actors in chains."""
    c = stored(_comments(spark, sf_dir))
    waves = stored(timing.attack_waves(c).select(F.explode("actors").alias("author"), F.col("start_us").alias("wave")))
    copies = stored(_copied(c))
    signals = stored(trolls.actor_signals(c, waves.select("author"), copies, trolls.linked_pages(c, KEYWORDS, 0.12), KEYWORDS, WORDS, trolls.MEMES, WORDS))
    prints = stored(identity.fingerprints(c, 2))
    now, past = (prints.filter(x).withColumn("campaign", F.lit(k)) for k, x in (("now", "author like '%/en'"), ("past", "author not like '%/en'")))
    found = trolls.evidence(signals, velocity=actors.velocity(c), waves=waves, copies=copies, morphs=identity.morphs(now, past, 0.92))
    return trolls.chains(found, trolls.actor_profiles(signals))
