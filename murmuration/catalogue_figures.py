"""Queries of a campaign's key figures. Their SQL stands on the SQL of the engines' own queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from murmuration import catalogue as own, catalogue_campaign, catalogue_feeds as feeds, catalogue_fusion, catalogue_groups, catalogue_identity, catalogue_trolls  # noqa: F401
from murmuration.catalogue import ORACLES, QUERIES, query, suspect_scores
from murmuration.catalogue_groups import GRAMS3, LIKE, WORDS
from murmuration.catalogue_psi import SUSPECTS
from murmuration.operators import figures, graph, text, timing
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables

ORACLES["template_actors"] = f"SELECT *, CASE WHEN texts >= 3 AND (vocab_ratio < 0.35 OR (mean_words <= 4 AND excl_rate >= 0.5)) THEN 'BOT_TEMPLATE' ELSE 'HUMAN' END AS style_label FROM ({ORACLES['style_features']})"

ORACLES["comment_signals"] = "WITH " + WORDS + ", " + GRAMS3 + ", " + LIKE.format(bar=0.65) + r""", k AS (SELECT a AS doc_id FROM j UNION SELECT b FROM j), z AS (SELECT doc_id, text, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS capitals, regexp_matches(lower(text), 'idiot|moron|scum') AS attack FROM w),
p AS (SELECT z.doc_id::VARCHAR AS id, least(100, CASE WHEN k.doc_id IS NOT NULL THEN 70 ELSE 0 END + CASE WHEN attack THEN 45 ELSE 0 END + CASE WHEN letters > 0 AND capitals / letters::DOUBLE > 0.55 THEN 30 ELSE 0 END
  + CASE WHEN attack AND coalesce(d.n_chars, 1) = 0 AND length(z.text) > 10 THEN 20 ELSE 0 END) AS points FROM z LEFT JOIN k USING (doc_id) JOIN documents d ON d.doc_id = z.doc_id)
SELECT id, points, CASE WHEN points >= 65 THEN 'CONFIRMED' WHEN points >= 35 THEN 'SUSPICIOUS' ELSE 'ORGANIC' END AS comment_label FROM p"""

ORACLES["post_signals"] = "WITH " + WORDS + ", " + GRAMS3 + ", " + LIKE.format(bar=0.45) + """, k AS (SELECT id, max(jaccard) AS most FROM (SELECT a AS id, jaccard FROM j UNION ALL SELECT b, jaccard FROM j) GROUP BY 1), p AS (SELECT doc_id, coalesce(text, '') AS text, n_chars % 7 AS r, n_chars % 11 AS s FROM documents),
q AS (SELECT doc_id::VARCHAR AS url, least(100, CASE WHEN r <= 3 AND s > r THEN 50 ELSE 0 END + CASE WHEN r + s = 0 AND length(text) > 20 THEN 55 ELSE 0 END + CASE WHEN most IS NOT NULL THEN least(85, trunc(100 * most) + 20) ELSE 0 END)::INT AS points FROM p LEFT JOIN k ON k.id = doc_id)
SELECT url, points, CASE WHEN points >= 60 THEN 'CONFIRMED' WHEN points >= 30 THEN 'SUSPICIOUS' ELSE 'ORGANIC' END AS post_label FROM q"""

BESIDE = "{C}, " + SUSPECTS + """, m AS (SELECT DISTINCT c.url, c.author, score >= 60 AS bot FROM c JOIN u ON u.author = c.author), pr AS (SELECT x.author AS bot, y.author AS operator, count(*) AS met FROM m x JOIN m y ON x.url = y.url AND x.bot AND NOT y.bot GROUP BY 1, 2 HAVING count(*) >= 2),
al AS (SELECT bot FROM pr GROUP BY 1 HAVING count(*) = 1), ps AS (SELECT operator, count(DISTINCT x.url) AS posts FROM pr JOIN m x ON x.author = pr.bot JOIN m y ON y.url = x.url AND y.author = pr.operator GROUP BY 1),
ob AS (SELECT operator, count(*) AS bots, round_even(count(*) FILTER (bot IN (SELECT bot FROM al)) / count(*)::DOUBLE, 3) AS exclusivity FROM pr GROUP BY 1 HAVING count(*) >= 2), ao AS (SELECT ob.*, posts, least(100, floor(round_even(least(100, 5 * posts) * 0.5::DOUBLE + 50 * exclusivity, 9)))::INT AS confidence FROM ob JOIN ps USING (operator)),
op AS (SELECT operator, bots, posts, exclusivity, confidence, CASE WHEN confidence >= 70 THEN 'CONFIRMED' WHEN confidence >= 40 THEN 'LIKELY' ELSE 'POSSIBLE' END AS operation FROM ao)"""


def _bots(spark, sf_dir):
    return suspect_scores(spark, sf_dir).filter("suspect_score >= 60").select("author")


@query("attributed_operators", BESIDE + " SELECT * FROM op")
def attributed_operators(spark, sf_dir):
    return figures.attributed_operators(tables.events(spark, sf_dir), _bots(spark, sf_dir))


@query("attribution_campaign", BESIDE + """, t AS (SELECT *, least(20, bots) AS shown FROM op ORDER BY confidence DESC, shown DESC, operator LIMIT 15)
SELECT count(*) AS operators, round_even(least(50.0::DOUBLE, 8.0 * count(*) FILTER (operation = 'CONFIRMED')) + least(50.0::DOUBLE, coalesce(5.0 * avg(shown), 0)), 1) AS score FROM t""")
def attribution_campaign(spark, sf_dir):
    return figures.attribution_score(attributed_operators(spark, sf_dir))


def _window(name: str, action: str) -> str:
    tone = ORACLES["contagion_windows"].replace("likes::DOUBLE AS tone", f"(action = '{action}')::INT::DOUBLE AS tone")
    return f"{name} AS (SELECT coalesce(avg(post), avg(during)) - coalesce(avg(pre), 0) AS rise FROM ({tone}))"


@query("contagion_direction", f"""WITH {_window("n", "error")}, {_window("p", "purchase")}, b AS (SELECT coalesce(round_even(n.rise, 9) >= 0.15, false) AS n, coalesce(round_even(p.rise, 9) >= 0.15, false) AS p FROM n, p)
SELECT CASE WHEN n AND p THEN 'MIXED' WHEN n THEN 'NEGATIVE' WHEN p THEN 'POSITIVE' ELSE 'NONE' END AS direction FROM b""")
def contagion_direction(spark, sf_dir):
    """Errors are the negative events, purchases the positive ones."""
    c = tables.events(spark, sf_dir)
    at = stored(timing.arrivals(c))
    share = lambda kind: timing.contagion(c.withColumn("tone", (F.col("action") == kind).cast("int")), at)
    return figures.contagion_direction(share("error"), share("purchase"))


@query("rotated_actors", "{C}, s AS (SELECT (us - min(us) OVER ()) // 3600000000 AS cohort, author FROM c), m AS (SELECT DISTINCT cohort, author FROM s QUALIFY count(DISTINCT author) OVER (PARTITION BY cohort) >= 3), f AS (SELECT * FROM (" + ORACLES["cohort_shift"] + ") WHERE shift <> 'NONE') SELECT DISTINCT author FROM f JOIN m USING (cohort) WHERE NOT EXISTS (FROM m n WHERE n.cohort = f.next AND n.author = m.author)")
def rotated_actors(spark, sf_dir):
    return figures.rotated_actors(timing.cohorts(tables.events(spark, sf_dir)), own.cohort_shift(spark, sf_dir))


def _clusters(spark, sf_dir):
    d = tables.documents(spark, sf_dir).withColumn("doc_id", F.col("pos"))
    return d, stored(own.text_clusters(spark, sf_dir)), d.filter("author like '%/fr'").select("author").distinct()


@query("narrative_clusters")
def narrative_clusters(spark, sf_dir):
    """Clusters of like documents; authors of French ones are the bots."""
    return figures.narrative_clusters(*_clusters(spark, sf_dir), "doc_id")


@query("narrative_roles")
def narrative_roles(spark, sf_dir):
    return figures.narrative_roles(*_clusters(spark, sf_dir), "doc_id")


@query("injection_campaign")
def injection_campaign(spark, sf_dir):
    """Clusters of like documents as narratives that actors bring to threads, one thread for each language."""
    d, clusters, _ = _clusters(spark, sf_dir)
    return figures.injection_score(text.injected_narratives(d.withColumn("url", F.substring_index("author", "/", -1)), clusters.select("doc_id", "cluster"), "doc_id"))


@query("pagerank_gini", "WITH r AS (SELECT rank AS x, row_number() OVER (ORDER BY rank) AS i FROM (" + ORACLES["pagerank"] + ")) SELECT round_even(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 4) AS gini, count(*) AS n FROM r")
def pagerank_gini(spark, sf_dir):
    return graph.gini(own.pagerank(spark, sf_dir), "rank")


@query("topology_campaign")
def topology_campaign(spark, sf_dir):
    ranks = pagerank_gini(spark, sf_dir)
    n = own.influence(spark, sf_dir).join(_bots(spark, sf_dir).select(F.col("author").alias("node"), F.lit(True).alias("suspect")), "node", "left").fillna(False, ["suspect"])
    return figures.topology_score(ranks, n, feeds.graph_coordination(spark, sf_dir))


#: Figures by the query whose rows they are taken from: in SQL's words, which Spark reads as well, but for those below.
TAKEN = {
    "source_totals": {"total_posts": "sum(posts)", "neg_pct": "round(100 * (sum(negative) + sum(aggressive)) / greatest(sum(posts), 1))"},
    "comment_signals": {"bot_pct": "round(100 * sum(CASE WHEN comment_label = 'CONFIRMED' THEN 1 ELSE 0 END) / greatest(count(*), 1))"},
    "graph_coordination": {"coord_score": "max(coordination)", "total_actors": "max(nodes)", "total_edges": "max(edges)"},
    "human_confidence": {"mean_hcs": "round(avg(hcs), 1)"},
    "page_groups": {"operators": "count(DISTINCT leader)"},
    "attack_sources": {"attack_pages": "count(*)"},
    "template_actors": {"stylo_bots": "sum(CASE WHEN style_label = 'BOT_TEMPLATE' THEN 1 ELSE 0 END)"},
    "campaign_scores": {f"{f}_score": f"max(CASE WHEN dimension = '{d}' THEN score END)" for f, d in (("sentiment", "sentiment_delta"), ("hashtag", "hashtag"), ("velocity", "velocity"), ("correlation", "correlation"), ("engagement", "engagement"), ("contagion", "contagion"), ("da", "dark_amp"), ("sh", "bot_farm_shift"), ("cc", "cross_campaign"))},
    "sentiment_delta": {"seeded_posts": "sum(CASE WHEN delta_label = 'SEEDED' THEN 1 ELSE 0 END)"},
    "seed_profiles": {"seed_accounts": "sum(CASE WHEN is_seed THEN 1 ELSE 0 END)"},
    "actor_lifecycle": {"sleeper_accounts": "sum(CASE WHEN role = 'SLEEPER' THEN 1 ELSE 0 END)"},
    "pagerank_gini": {"pagerank_gini": "max(gini)"},
    "tag_adoption": {"weaponized_tags": "sum(CASE WHEN tag_label <> 'ORGANIC' THEN 1 ELSE 0 END)"},
    "velocity_campaign": {"bot_velocity_actors": "max(bots)"},
    "seeding_campaign": {"seeding_score": "max(score)", "seeded_narratives": "max(seeds)"},
    "correlation_campaign": {"high_corr_pairs": "max(high)"},
    "attribution_campaign": {"attribution_score": "max(score)", "attributed_operators": "max(operators)"},
    "hunt_score": {"troll_score": "max(score)", "confirmed_bots": "max(confirmed)"},
    "name_parts": {"foreign_name_actors": "sum(CASE WHEN label = 'A' THEN 1 ELSE 0 END)"},
    "actor_signals": {"page_operators": "sum(CASE WHEN signal = 'S2_PAGE' THEN 1 ELSE 0 END)"},
    "engagement_anomaly": {"bot_boosted_posts": "sum(CASE WHEN anomaly = 'BOT_BOOSTED' THEN 1 ELSE 0 END)", "ghost_posts": "sum(CASE WHEN anomaly = 'GHOST' THEN 1 ELSE 0 END)"},
    "contagion_direction": {"contagion_direction": "max(direction)"},
    "contagion_windows": {"contagion_affected": "sum(CASE WHEN confirmed THEN 1 ELSE 0 END)"},
    "identity_persistence": {"id_score": "max(score)", "id_confirmed_morphs": "max(confirmed)", "id_unique_operators": "max(operators)"},
    "dark_amplification": {"da_dark_posts": "sum(CASE WHEN amplification = 'DARK_AMP' THEN 1 ELSE 0 END)", "da_baseline": "median(velocity)"},
    "cohort_shift": {"sh_confirmed": "sum(CASE WHEN shift IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END)"},
    "rotated_actors": {"sh_rotated": "count(*)"},
    "reply_campaign": {"rc_score": "max(score)"},
    "hijacked_threads": {"rc_hijacked_posts": "sum(CASE WHEN hijacked THEN 1 ELSE 0 END)"},
    "career_hijackers": {"rc_career_hijackers": "count(*)"},
    "registry_rollup": {"cc_professional": "sum(CASE WHEN career = 'PROFESSIONAL' THEN 1 ELSE 0 END)"},
    "registry_counts": {"cc_total_tracked": "max(actors)"},
}
#: The rest come from queries that have no SQL.
REST = {
    "temporal_campaign": {"temporal_score": "max(score)"},
    "attack_waves": {"attack_waves": "count(*)"},
    "style_groups": {"stylo_clusters": "count(DISTINCT leader)"},
    "narrative_clusters": {"bot_clusters": "sum(CASE WHEN label = 'BOT_DOMINATED' THEN 1 ELSE 0 END)"},
    "lifecycle_campaign": {"lifecycle_score": "max(score)"},
    "sleeper_cells": {"sleeper_cells": "count(*)"},
    "injection_campaign": {"injection_score": "max(score)", "narratives_found": "max(narratives)"},
    "topology_campaign": {"topology_score": "max(score)"},
    "narrative_campaign": {"mut_score": "max(score)"},
    "mutation_spread": {"mut_pivot": "sum(CASE WHEN mutation = 'PIVOT' THEN 1 ELSE 0 END)", "mut_total": "count(*)"},
}
WITH_SQL = [n for n in figures.FIGURES if any(n in wanted for wanted in TAKEN.values())]


def _value(figure: str) -> str:
    return f"coalesce(max({figure}), '{figures.WORDS[figure]}')" if figure in figures.WORDS else f"coalesce(max({figure}), 0)::DOUBLE"


def _sql() -> str:
    one = [f"f{i} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in wanted.items())} FROM ({ORACLES[name]}))" for i, (name, wanted) in enumerate(TAKEN.items())]
    return "WITH " + ",\n".join(one) + " SELECT " + ", ".join(f"{_value(n)} AS {n}" for n in WITH_SQL) + " FROM " + ", ".join(f"f{i}" for i in range(len(TAKEN)))


def _frames(spark, sf_dir, taken, at_once: int = 4):
    """The engines' rows; those that work in rounds do so beside each other."""
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(lambda name: QUERIES[name](spark, sf_dir), taken))
    return [(r, {n: F.expr(e) for n, e in wanted.items()}) for r, wanted in zip(rows, taken.values())]


@query("report_figures", _sql())
def report_figures(spark, sf_dir):
    """The figures whose engines have SQL, in one row."""
    return figures.figures(_frames(spark, sf_dir, TAKEN), WITH_SQL)


@query("report_figures_whole")
def report_figures_whole(spark, sf_dir):
    """All figures of the report in one row."""
    roles, clusters = narrative_roles(spark, sf_dir), narrative_clusters(spark, sf_dir)
    score = [(figures.narrative_score(clusters, roles), {"narrative_score": F.max("score")})]
    return figures.figures(_frames(spark, sf_dir, TAKEN | REST) + score)
