"""Queries of hijacked threads and of changing narratives, and the fusion of all twelve dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration import catalogue as own
from murmuration.catalogue import query, suspect_scores
from murmuration.catalogue_campaign import campaign_scores
from murmuration.catalogue_identity import identity_persistence
from murmuration.catalogue_psi import SUSPECTS, psi_core_report
from murmuration.catalogue_trolls import hunt_score
from murmuration.functions.text import tokens
from murmuration.operators import campaign, feeds, replies, risk, timing
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables

TARGETS = "{C}, " + SUSPECTS + r""", e AS (SELECT url, pos, 'u' || c.author AS author, us, likes, lower(regexp_extract('@U' || likes, '^@([A-Za-z][^\s,]{1,40})', 1)) AS said, score >= 60 AS bot FROM c JOIN u ON u.author = c.author),
z AS (SELECT url, count(*) AS total, count(*) FILTER (bot) AS bots FROM e GROUP BY 1),
p AS (SELECT a.url, a.pos, a.author AS target, count(*) AS n, list_sort(list(b.us - a.us)) AS gaps, list_sort(list_distinct(list(b.author))) AS attackers FROM e a JOIN e b ON a.url = b.url AND b.us > a.us AND b.us - a.us <= 3600000000 AND NOT a.bot AND b.bot AND a.likes >= 3 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
t1 AS (SELECT p.url, target, 'TEMPORAL' AS kind, attackers, least(100, floor(round_even(n / greatest(bots, 1)::DOUBLE * 60 + (1 - least(1.0::DOUBLE, gaps[len(gaps) // 2 + 1] / 1000000.0::DOUBLE / 3600)) * 40, 9)))::INT AS intensity, bots, total FROM p JOIN z USING (url)),
o AS (SELECT url, author AS target, min(struct_pack(us := us, pos := pos)) AS first FROM e WHERE NOT bot AND likes >= 3 GROUP BY 1, 2), s AS (SELECT DISTINCT url, author, said FROM e WHERE bot AND said <> ''),
h AS (SELECT s.url, s.author, said, arg_min(target, struct_pack(a := first, b := target)) AS target FROM s JOIN o ON o.url = s.url AND contains(lower(target), said) GROUP BY 1, 2, 3),
t2 AS (SELECT h.url, target, 'MENTION' AS kind, list_sort(list_distinct(list(author))) AS attackers, 30 AS intensity, any_value(bots) AS bots, any_value(total) AS total FROM h JOIN z USING (url) WHERE (h.url, target) NOT IN (SELECT url, target FROM t1) GROUP BY 1, 2),
t3 AS (SELECT z.url, 'MULTIPLE' AS target, 'SATURATION' AS kind, (SELECT list_sort(list_distinct(list(author))) FROM e WHERE e.url = z.url AND bot) AS attackers, least(100, floor(round_even(bots / total::DOUBLE * 100, 9)))::INT AS intensity, bots, total FROM z
  WHERE bots >= 3 AND bots / total::DOUBLE >= 0.6 AND url NOT IN (SELECT url FROM t1 UNION SELECT url FROM t2)),
t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
q AS (SELECT url, kind, count(*) AS k, sum(intensity) AS s, max(bots / total::DOUBLE) AS sat FROM t GROUP BY 1, 2), v AS (SELECT url, sum(k)::BIGINT AS targets, sum(s) / sum(k) AS mean, max(sat) AS sat, arg_min(kind, struct_pack(a := -k, b := CASE kind WHEN 'TEMPORAL' THEN 0 WHEN 'MENTION' THEN 1 ELSE 2 END)) AS dominant FROM q GROUP BY 1),
y AS (SELECT url, targets, round_even(sat, 3) AS saturation, dominant, least(100, floor(round_even(mean * 0.8 + floor(round_even(sat * 20, 9)), 9)))::INT AS hijack_score FROM v)"""


def _targets(spark, sf_dir):
    """Events as comments that address an actor by the beginning of a number; suspects are the bots."""
    c = tables.events(spark, sf_dir).withColumn("author", F.concat(F.lit("u"), "author")).withColumn("text", F.concat(F.lit("@U"), F.col("likes").cast("string")))
    bots = suspect_scores(spark, sf_dir).filter("suspect_score >= 60").select(F.concat(F.lit("u"), "author").alias("author"))
    return replies.reply_targets(c, bots, within_s=3600)


@query("reply_targets", TARGETS + " SELECT url, target, kind, array_to_string(attackers, ',') AS attackers, intensity FROM t")
def reply_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("url", "target", "kind", F.array_join("attackers", ",").alias("attackers"), "intensity")


@query("hijacked_threads", TARGETS + " SELECT *, hijack_score >= 40 AS hijacked FROM y")
def hijacked_threads(spark, sf_dir):
    return replies.hijacked_threads(_targets(spark, sf_dir))


@query("career_hijackers", TARGETS + " SELECT author, count(*) AS targets FROM (SELECT unnest(attackers) AS author FROM t) GROUP BY 1 HAVING count(*) >= 3")
def career_hijackers(spark, sf_dir):
    return replies.career_hijackers(_targets(spark, sf_dir))


@query("reply_campaign", TARGETS + " SELECT round_even(least(100, 50 * count(*) FILTER (hijack_score >= 40) / count(*)::DOUBLE + least(50, avg(hijack_score) / 2)), 1) AS score FROM y")
def reply_campaign(spark, sf_dir):
    return campaign.reply_hijacks(hijacked_threads(spark, sf_dir)).select("score")


#: Names whose appearance is told apart, and the words that weigh, in the tables' invented prose.
NAMES, LEXICON = ["thereat", "inand", "schver", "leelle"], [("idiot", "neg", 4.0), ("moron", "agg", 4.0), ("scum", "agg", 4.0), ("good", "pos", 2.0)]


def _narrative(spark, sf_dir):
    """Documents of one in ten seconds in windows of half an hour, every quarter: rows, their terms, and changes between windows."""
    docs = tables.documents(spark, sf_dir).withColumn("us", F.col("pos") * 10_000_000)
    rows = timing.sliding_windows(docs, 30, 15)
    # a document's words are made and kept once; windows, of which it is in two, and single words come when they are read
    words = stored(docs.select("pos", "author", "us", F.array_distinct(tokens(F.col("text"), 4)).alias("words")))
    terms = timing.sliding_windows(words, 30, 15, since=True).select("window", "since", F.col("pos").alias("doc"), "author", "us", F.explode("words").alias("term"))
    return rows, terms, timing.narrative_mutations(terms, bar=0.999, voices=timing.window_voices(rows, NAMES))


@query("window_voices", r"""WITH d AS (SELECT doc_id * 10000000 AS us, coalesce(text, '') AS text FROM documents), z AS (SELECT us - min(us) OVER () AS d, text FROM d),
w AS (SELECT unnest(range(greatest(0, CASE WHEN d < 1800000000 THEN 0 ELSE (d - 1800000000) // 900000000 + 1 END), d // 900000000 + 1)) AS "window", regexp_extract_all(text, '[\p{L}\p{N}_]+') AS runs FROM z)
SELECT "window", sum(len(list_filter(runs, lambda x: regexp_full_match(x, '[A-ZÁÉÍÓÚÜÑ]{3,}')))) AS caps, array_to_string(list_sort(list_distinct(flatten(list(list_filter(list_transform(runs, lambda x: lower(x)), lambda x: list_contains(['thereat', 'inand', 'schver', 'leelle'], x)))))), ',') AS entities FROM w GROUP BY 1""")
def window_voices(spark, sf_dir):
    rows = timing.sliding_windows(tables.documents(spark, sf_dir).withColumn("us", F.col("pos") * 10_000_000), 30, 15)
    return timing.window_voices(rows, NAMES).withColumn("entities", F.array_join("entities", ","))


@query("mutation_spread")
def mutation_spread(spark, sf_dir):
    _, terms, m = _narrative(spark, sf_dir)
    return timing.mutation_spread(m, terms)


@query("narrative_campaign")
def narrative_campaign(spark, sf_dir):
    rows, _, m = _narrative(spark, sf_dir)
    lexicon = spark.createDataFrame(LEXICON, "phrase string, dimension string, score double")
    felt = feeds.sentiment(tables.documents(spark, sf_dir).withColumn("id", F.col("pos")), lexicon, ["id"]).select("id", (F.col("negative_score") + F.col("aggressive_score")).alias("intensity"))
    return campaign.narrative_mutations(m, rows.select("window", F.col("pos").alias("id")).join(felt, "id").groupBy("window").agg(F.avg("intensity").alias("intensity")))


@query("fusion_scores")
def fusion_scores(spark, sf_dir):
    """The scores of all dimensions."""
    return campaign_scores(spark, sf_dir).union(campaign.all_scores({
        "troll_hunter": hunt_score(spark, sf_dir), "temporal": own.temporal_campaign(spark, sf_dir), "reply_chain": reply_campaign(spark, sf_dir),
        "identity": identity_persistence(spark, sf_dir), "narrative_mut": narrative_campaign(spark, sf_dir), "psi_core": psi_core_report(spark, sf_dir),
    }))


@query("campaign_fusion_whole")
def campaign_fusion_whole(spark, sf_dir):
    return risk.fuse(fusion_scores(spark, sf_dir))
