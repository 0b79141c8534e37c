"""Queries of the campaign scores and their fusion. Their SQL stands on the SQL of the engines' own queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration import catalogue as own
from murmuration.catalogue import ORACLES, query
from murmuration.catalogue_feeds import graph_coordination
from murmuration.operators import campaign, risk
from murmuration.sources import tables

SCORED = {
    "engagement": ("engagement_anomaly", "60 * (count(*) FILTER (anomaly = 'BOT_BOOSTED') + 0.5 * count(*) FILTER (anomaly = 'SUSPICIOUS')) / nullif(count(*), 0)::DOUBLE + least(40, coalesce(0.8 * avg(anomaly_score), 0))"),
    "dark_amp": ("dark_amplification", "60 * (count(*) FILTER (amplification = 'DARK_AMP') + 0.4 * count(*) FILTER (amplification = 'SUSPICIOUS')) / nullif(count(*), 0)::DOUBLE + least(40, coalesce(4 * avg(factor), 0))"),
    "cross_campaign": ("registry_rollup", "(40 * count(*) FILTER (career = 'PROFESSIONAL') + 30 * count(*) FILTER (career = 'PERSISTENT')) / (SELECT greatest(count(DISTINCT user_id), 1) FROM events)::DOUBLE + least(30, coalesce(0.3 * avg(mean_score), 0))"),
    "bot_farm_shift": ("cohort_shift", "15 * count(*) FILTER (shift IN ('HIGH', 'MEDIUM')) + least(25, coalesce(25 * (sum(bots) + arg_max(next_bots, cohort)) / (count(*) + 1), 0)) + least(60, coalesce(60 * avg(turnover) FILTER (shift <> 'NONE'), 0))"),
    "hashtag": ("tag_adoption", "60 * count(*) FILTER (tag_label <> 'ORGANIC') / nullif(count(*), 0)::DOUBLE + least(40, coalesce(15 * avg(rate) FILTER (tag_label <> 'ORGANIC'), 0))"),
    "contagion": ("contagion_windows", "30 * count(*) FILTER (confirmed) / nullif(count(*), 0)::DOUBLE + least(70, coalesce(210 * avg(abs(shift)), 0))"),
    "sentiment_delta": ("sentiment_delta", "60 * count(*) FILTER (delta_label = 'SEEDED') / nullif(count(*), 0)::DOUBLE + least(40, coalesce(200 * avg(abs(delta)), 0))"),
}
ALL = "\nUNION ALL ".join(f"SELECT '{d}' AS dimension, round_even(least(100, coalesce({points}, 0)), 1)::DOUBLE AS score FROM ({ORACLES[name]})" for d, (name, points) in SCORED.items())
ALL += f"\nUNION ALL SELECT 'cib_graph', coordination::DOUBLE FROM ({ORACLES['graph_coordination']})\nUNION ALL SELECT 'correlation', score::DOUBLE FROM ({ORACLES['correlation_campaign']})\nUNION ALL SELECT 'velocity', score::DOUBLE FROM ({ORACLES['velocity_campaign']})"


@query("campaign_scores", ALL)
def campaign_scores(spark, sf_dir):
    tracked = tables.events(spark, sf_dir).select("author").distinct().count()
    return campaign.all_scores({
        "engagement": campaign.engagement(own.engagement_anomaly(spark, sf_dir)), "dark_amp": campaign.dark_amplification(own.dark_amplification(spark, sf_dir)),
        "cross_campaign": campaign.cross_campaign(own.registry_rollup(spark, sf_dir), tracked), "bot_farm_shift": campaign.farm_shift(own.cohort_shift(spark, sf_dir)),
        "hashtag": campaign.hashtags(own.tag_adoption(spark, sf_dir)), "contagion": campaign.contagion(own.contagion_windows(spark, sf_dir)),
        "sentiment_delta": campaign.seeded_sentiment(own.sentiment_delta(spark, sf_dir)),
        "cib_graph": graph_coordination(spark, sf_dir).withColumn("score", F.col("coordination")), "correlation": own.correlation_campaign(spark, sf_dir), "velocity": own.velocity_campaign(spark, sf_dir),
    })


@query("campaign_fusion", f"""WITH s AS ({ALL}), w AS (FROM (VALUES ('troll_hunter', 0.22::DOUBLE), ('cib_graph', 0.16), ('temporal', 0.13), ('narrative_mut', 0.09), ('dark_amp', 0.07), ('engagement', 0.07), ('contagion', 0.05), ('reply_chain', 0.04), ('bot_farm_shift', 0.03), ('cross_campaign', 0.02), ('identity', 0.01), ('psi_core', 0.10)) v(dimension, weight)),
a AS (SELECT coalesce(sum(score * weight) FILTER (score > 0), 0) AS sw, coalesce(sum(weight) FILTER (score > 0), 0) AS w, count(*) FILTER (score > 0) AS active FROM s JOIN w USING (dimension)), f AS (SELECT CASE WHEN w > 0 THEN round_even(sw / w * 0.99, 1) ELSE 0 END::DOUBLE AS fused, active FROM a)
SELECT fused, active, CASE WHEN active >= 3 THEN 'SUFFICIENT' WHEN active >= 1 THEN 'LOW' ELSE 'INSUFFICIENT' END AS quality, CASE WHEN active < 1 THEN 'ORGANIC' WHEN fused >= 80 THEN 'CRITICAL' WHEN fused >= 60 THEN 'HIGH' WHEN fused >= 40 THEN 'MODERATE' WHEN fused >= 20 THEN 'LOW' ELSE 'ORGANIC' END AS label FROM f""")
def campaign_fusion(spark, sf_dir):
    """The whole campaign's fused score from the engines that have one; missing dimensions give their weight away."""
    return risk.fuse(campaign_scores(spark, sf_dir))


@query("lifecycle_campaign")
def lifecycle_campaign(spark, sf_dir):
    return campaign.lifecycle(own.actor_lifecycle(spark, sf_dir), own.sleeper_cells(spark, sf_dir).count())


@query("first_mover_campaign")
def first_mover_campaign(spark, sf_dir):
    movers = own.first_movers(spark, sf_dir)
    return campaign.first_movers(own.seed_profiles(spark, sf_dir), own.seed_teams(spark, sf_dir).count(), movers.select("url").distinct().count())
