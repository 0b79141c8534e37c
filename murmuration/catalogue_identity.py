"""Queries of returning actors."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.catalogue import query
from murmuration.operators import identity
from murmuration.sources import tables

ATTACKS = "[" + ", ".join(f"'{w}'" for w in identity.ATTACKS) + "]"
PRINTS = rf"""a AS (SELECT 'NOW' AS campaign, source || '/' || lang AS author, trim(text, ' ') AS t FROM documents UNION ALL SELECT 'PAST', conv_id || '/' || role, trim(text, ' ') FROM conversations),
w AS (SELECT campaign, author, t, regexp_extract_all(lower(t), '[^\s\x{{85}}\p{{Z}}]+') AS ws, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS runs FROM a WHERE length(t) > 0 AND trim(author, ' ') NOT IN ('', '?')),
s AS (SELECT campaign, author, count(*) AS n, sum(len(ws)) AS n_words, sum(length(t)) + count(*) - 1 AS chars, stddev_pop(len(ws)) AS spread, sum(len(regexp_extract_all(t, '{identity.EMOJI.replace(chr(92) + 'x', chr(92) + 'x')}'))) AS emoji,
  sum(len(regexp_extract_all(t, '{identity.MARKS.replace("'", "''")}'))) AS marks, sum(len(regexp_extract_all(t, '\d'))) AS digits, sum(len(list_filter(runs, lambda x: regexp_full_match(x, '{identity.CAPITALS}')))) AS capitals,
  sum(len(list_filter(runs, lambda x: list_contains({ATTACKS}, lower(x))))) AS attacks FROM w GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT campaign, author, count(DISTINCT x) AS kinds FROM (SELECT campaign, author, unnest(ws) AS x FROM w) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT campaign, author, n, [round_even(coalesce(kinds, 0) / greatest(n_words, 1)::DOUBLE, 4), round_even(least(1.0::DOUBLE, n_words / n::DOUBLE / 50), 4), round_even(least(1.0::DOUBLE, capitals / greatest(n_words, 1)::DOUBLE), 4), round_even(least(1.0::DOUBLE, emoji / n::DOUBLE), 4),
  round_even(least(1.0::DOUBLE, marks / chars::DOUBLE * 10), 4), round_even(least(1.0::DOUBLE, attacks / n::DOUBLE), 4), round_even(least(1.0::DOUBLE, digits / chars::DOUBLE * 5), 4), round_even(least(1.0::DOUBLE, spread / 20), 4)]::DOUBLE[] AS f FROM s LEFT JOIN k USING (campaign, author))"""
NAMES = "[" + ", ".join(f"'{x}'" for x in identity.FEATURES) + "]"
MORPHS = "WITH " + PRINTS + f""", c AS (SELECT x.author AS now, y.author AS was, x.f AS g, y.f AS h, round_even(list_cosine_similarity(x.f, y.f), 4) AS cosine FROM p x JOIN p y ON x.campaign = 'NOW' AND y.campaign = 'PAST' AND lower(trim(x.author)) <> lower(trim(y.author))),
m AS (SELECT now, was, 'PAST' AS campaign, cosine, CASE WHEN cosine >= 0.92 THEN 'CONFIRMED' WHEN cosine >= 0.85 THEN 'PROBABLE' ELSE 'POSSIBLE' END AS identity,
  array_to_string([{NAMES}[i] FOR i IN range(1, 9) IF abs(g[i] - h[i]) < 0.08][:5], ',') AS alike FROM c WHERE cosine >= 0.75)"""


def _prints(spark, sf_dir):
    """Fingerprints of the documents' sources by language, and of speakers in conversations as the past."""
    now = identity.fingerprints(tables.documents(spark, sf_dir), 2).withColumn("campaign", F.lit("NOW"))
    c = tables.conversations(spark, sf_dir).withColumn("author", F.concat_ws("/", "url", "author"))
    return now, identity.fingerprints(c, 2).withColumn("campaign", F.lit("PAST"))


@query("fingerprints", "WITH " + PRINTS + " SELECT campaign, author, n, " + ", ".join(f"f[{k + 1}] AS {x}" for k, x in enumerate(identity.FEATURES)) + " FROM p")
def fingerprints(spark, sf_dir):
    now, past = _prints(spark, sf_dir)
    return now.unionByName(past).select("campaign", "author", "n", *[F.col("fingerprint")[k].alias(x) for k, x in enumerate(identity.FEATURES)])


@query("identity_morphs", MORPHS + " SELECT * FROM m")
def identity_morphs(spark, sf_dir):
    return identity.morphs(*_prints(spark, sf_dir))


@query("identity_persistence", MORPHS + """, b AS (SELECT count(*) AS pairs, count(*) FILTER (identity = 'CONFIRMED') AS confirmed, count(*) FILTER (identity = 'PROBABLE') AS probable, avg(cosine) AS mean FROM (SELECT * FROM m ORDER BY cosine DESC, now, was, campaign LIMIT 20)),
z AS (SELECT count(*) AS actors FROM p WHERE campaign = 'NOW') SELECT actors, pairs, confirmed, probable, CASE WHEN actors > 0 THEN greatest(1, actors - confirmed) ELSE 0 END::BIGINT AS operators, CASE WHEN pairs > 0 THEN round_even(least(100.0::DOUBLE, 25.0 * confirmed + 10.0 * probable + 20 * mean), 1) ELSE 0 END AS score FROM z, b""")
def identity_persistence(spark, sf_dir):
    now, past = _prints(spark, sf_dir)
    return identity.persistence(now, identity.morphs(now, past))
