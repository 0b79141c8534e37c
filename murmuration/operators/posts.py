"""Operators on posts: engagement anomalies, dark amplification, correlation, attack sources, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.operators.actors import HOUR, known
from murmuration.plans.joins import shared_members


def dedup_posts(posts: DataFrame, order: str = "pos") -> DataFrame:
    """First post of each url, or of each beginning of the text where the url is missing."""
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.substring("text", 1, 80))
    return posts.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def upsert_posts(posts: DataFrame) -> DataFrame:
    """One row per url: longest text, first source and time that are known, largest counters, engagement anew."""
    g = posts.groupBy("url").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("text"), F.min_by("source", F.when(F.col("source") != "", F.col("pos"))).alias("source"),
        F.min_by("us", F.when(F.col("us").isNotNull(), F.col("pos"))).alias("us"), *[F.max(c).alias(c) for c in ("reactions", "comments_count", "shares")],
    )
    return g.withColumn("engagement_total", sum((F.coalesce(c, F.lit(0)) for c in ("reactions", "comments_count", "shares")), F.lit(0)))


def keyword_filter(posts: DataFrame, keywords: list[str], least_engagement: int = 0) -> DataFrame:
    """Posts that hold any of the keywords (lower case; none given: all) with enough engagement."""
    kept = posts.filter(F.col("reactions") + F.col("comments_count") + F.col("shares") >= least_engagement)
    return kept.filter(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("text"), k))) if keywords else kept


def engagement_anomaly(posts: DataFrame, least_reactions: int = 5) -> DataFrame:
    """Reactions per comment against the median post: label, deviation and score of every post."""
    p = posts.filter(F.col("reactions") >= least_reactions).withColumn("ratio", F.col("reactions") / F.greatest(F.col("comments_count"), F.lit(1)))
    base = p.agg(F.median("ratio").alias("base"))
    p = p.crossJoin(F.broadcast(base))
    ghost = (F.col("reactions") >= 20) & (F.col("comments_count") <= 2) & (F.col("shares") <= 2)
    label = F.when(ghost, "GHOST").when((F.col("ratio") >= 10) & (F.col("shares") / F.col("reactions") >= 0.15), "AMPLIFIED").when(F.col("ratio") >= 10, "BOT_BOOSTED").when(F.col("ratio") >= 5, "SUSPICIOUS").otherwise("ORGANIC")
    p = p.withColumn("anomaly", label).withColumn("deviation", F.bround(100 * (F.col("ratio") - F.col("base")) / F.greatest(F.col("base"), F.lit(0.01)), 2))
    d = F.greatest(F.col("deviation"), F.lit(0.0))
    score = F.when(F.col("anomaly") == "GHOST", 100).when(F.col("anomaly") == "BOT_BOOSTED", F.least(F.lit(90), (40 + 0.3 * d).cast("int"))).when(F.col("anomaly") == "AMPLIFIED", F.least(F.lit(50), (0.35 * d).cast("int"))).when(F.col("anomaly") == "SUSPICIOUS", F.least(F.lit(40), (0.4 * d).cast("int"))).otherwise(0)
    return p.select("url", "reactions", "comments_count", "shares", F.bround("ratio", 4).alias("ratio"), "anomaly", "deviation", score.cast("int").alias("anomaly_score"))


def dark_amplification(posts: DataFrame, now_us: Column, least_engagement: int = 50, purity: Column | None = None, burst: Column | None = None) -> DataFrame:
    """Engagement per hour against the median, with the share of suspicious commenters (purity) and of early comments
    (burst) where they are known. A missing time counts as 24 hours of age."""
    zero = F.lit(0.0)
    p = posts.withColumn("engagement", F.col("reactions") + F.col("comments_count") + F.col("shares"))
    p = p.withColumn("age_h", F.coalesce(F.greatest((now_us - F.col("us")) / HOUR, F.lit(0.1)), F.lit(24.0)))
    p = p.filter((F.col("engagement") >= least_engagement) & (F.col("age_h") >= 0.5)).withColumn("velocity", F.col("engagement") / F.col("age_h"))
    p = p.withColumn("purity", purity if purity is not None else zero).withColumn("burst", burst if burst is not None else zero)
    p = p.crossJoin(F.broadcast(p.agg(F.median("velocity").alias("mid")))).withColumn("factor", F.col("velocity") / F.greatest(F.col("mid"), F.lit(1e-9)))
    talked = (F.col("comments_count") >= 0.15 * F.col("engagement")) | (F.col("shares") >= 0.05 * F.col("engagement"))
    label = F.when((F.col("factor") >= 5) & talked & (F.col("purity") < 0.85), "VIRAL_GENUINE").when(F.col("factor") >= 5, "DARK_AMP").when((F.col("factor") >= 3) & ((F.col("purity") >= 0.7) | (F.col("burst") >= 0.7)), "SUSPICIOUS").otherwise("ORGANIC")
    p = p.withColumn("amplification", label)
    score = F.when(F.col("amplification") == "ORGANIC", 0).when(F.col("amplification") == "VIRAL_GENUINE", F.greatest(F.lit(5), (4 * F.col("factor")).cast("int"))).otherwise(F.least(F.lit(100), F.least(F.lit(60), (6 * F.col("factor")).cast("int")) + (20 * F.col("purity")).cast("int") + (20 * F.col("burst")).cast("int")))
    return p.select("url", "engagement", F.bround("age_h", 3).alias("age_h"), F.bround("velocity", 3).alias("velocity"), F.bround("factor", 3).alias("factor"), "amplification", score.cast("int").alias("amplification_score"))


def post_correlation(comments: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of posts with at least `least` actors in common: Jaccard and level."""
    p = shared_members(known(comments), "url", "author").filter(F.col("shared") >= least).withColumn("jaccard", F.bround("jaccard", 4))
    return p.withColumn("level", F.when(F.col("jaccard") >= 0.35, "HIGH").when(F.col("jaccard") >= 0.15, "MEDIUM").otherwise("LOW"))


def correlation_campaign(pairs: DataFrame) -> DataFrame:
    a = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("level") == "HIGH").alias("high"), F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("mean_jaccard"))
    share = F.when(F.col("pairs") > 0, F.col("high") / F.col("pairs")).otherwise(0.0)
    return a.withColumn("score", F.bround(F.least(F.lit(100.0), 70 * share + F.least(F.lit(30.0), 50 * F.col("mean_jaccard"))), 1))


def source_overlap(comments: DataFrame) -> DataFrame:
    """All pairs of sources (few) with the actors they share; those without any are kept."""
    m = known(comments).select("source", "author").distinct()
    s = m.groupBy("source").agg(F.count(F.lit(1)).alias("actors"))
    every = s.select(F.col("source").alias("a"), F.col("actors").alias("size_a")).join(s.select(F.col("source").alias("b"), F.col("actors").alias("size_b")), F.col("a") < F.col("b"))
    both = shared_members(m, "source", "author").select("a", "b", "shared")
    p = every.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    p = p.withColumn("jaccard", F.bround(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 4))
    return p.withColumn("level", F.when(F.col("jaccard") >= 0.30, "HIGH").when(F.col("jaccard") >= 0.15, "MEDIUM").when(F.col("jaccard") >= 0.05, "LOW").otherwise("NONE"))


def multi_source_actors(comments: DataFrame, least: int = 2) -> DataFrame:
    """Actors on at least `least` sources, with what they did there."""
    a = known(comments).groupBy("author").agg(F.count_distinct("source").alias("sources"), F.count_distinct("url").alias("posts"), F.count(F.lit(1)).alias("comments"))
    return a.filter(F.col("sources") >= least)


def bipartite_attribution(rows: DataFrame, left: str, right: str, via: str, least: int = 2) -> DataFrame:
    """Pairs of a left and a right actor that meet on at least `least` different `via`, with the share of the left
    actor's that this is, a confidence and a label."""
    m = rows.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(via).alias("v")).distinct()
    own = m.select("l", "v").distinct().groupBy("l").agg(F.count(F.lit(1)).alias("all"))
    p = m.groupBy("l", "r").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= least).join(own, "l")
    p = p.withColumn("exclusivity", F.col("met") / F.col("all"))
    c = F.bround(F.least(F.lit(100.0), F.col("met") * 5.0) / 2 + 50 * F.col("exclusivity"), 2)
    p = p.withColumn("confidence", c)
    return p.select("l", "r", "met", F.bround("exclusivity", 4).alias("exclusivity"), "confidence", F.when(F.col("confidence") >= 70, "CONFIRMED").when(F.col("confidence") >= 40, "PROBABLE").otherwise("POSSIBLE").alias("attribution"))


def attack_sources(posts: DataFrame, attack: str = "attack", least: int = 2, share: float = 0.8) -> DataFrame:
    """Sources of at least `least` posts of which `share` attack."""
    a = posts.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col(attack)).alias("attacks"), F.bround(F.avg("reactions"), 2).alias("mean_reactions"))
    return a.filter((F.col("posts") >= least) & (F.col("attacks") / F.col("posts") >= share))


def top_per_source(posts: DataFrame, by: str = "reactions", k: int = 3) -> DataFrame:
    """The k best posts of every source, ties to the smaller pos."""
    r = F.row_number().over(W.partitionBy("source").orderBy(F.col(by).desc(), "pos"))
    return posts.withColumn("rank", r).filter(F.col("rank") <= k)


def priority_score(negative: Column, aggressive: Column, engagement: Column) -> Column:
    """0 to 100 from shares of negative and aggressive comments and engagement on a logarithmic scale."""
    reach = F.least(F.log10(F.greatest(engagement, F.lit(1))) / 4, F.lit(1.0))
    return F.bround(100 * (0.45 * negative + 0.25 * aggressive + 0.30 * reach), 1)


def page_ownership(suspects: DataFrame, least: int = 2) -> DataFrame:
    """suspects (page, author): pairs of pages that share suspicious actors, with risk and confidence."""
    p = shared_members(suspects, "page", "author").filter(F.col("shared") >= least).withColumn("jaccard", F.bround("jaccard", 4))
    risk = F.when((F.col("jaccard") >= 0.60) & (F.col("shared") >= 5), "CONFIRMED").when((F.col("jaccard") >= 0.35) & (F.col("shared") >= 3), "PROBABLE").when(F.col("jaccard") >= 0.20, "SUSPECTED").otherwise("LOW")
    conf = F.greatest(F.lit(1), F.least(F.lit(99), (40 * F.col("jaccard") + 30 * F.least(F.col("shared") / 10, F.lit(1.0))).cast("int")))
    return p.withColumn("risk", risk).withColumn("confidence", conf)
