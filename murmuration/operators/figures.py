"""The key figures of a campaign: scores that rest on several engines' rows, and one row of all figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.operators.actors import known
from murmuration.plans import products
from murmuration.plans.checkpoints import stored

#: Figures of the report (fixed names, in order).
FIGURES = """total_posts bot_pct neg_pct coord_score mean_hcs operators attack_pages total_actors total_edges temporal_score attack_waves stylo_bots stylo_clusters
sentiment_score seeded_posts seed_accounts narrative_score bot_clusters lifecycle_score sleeper_accounts sleeper_cells injection_score narratives_found topology_score
pagerank_gini hashtag_score weaponized_tags velocity_score bot_velocity_actors seeding_score seeded_narratives correlation_score high_corr_pairs attribution_score
attributed_operators troll_score confirmed_bots foreign_name_actors page_operators engagement_score bot_boosted_posts ghost_posts contagion_score contagion_direction
contagion_affected id_score id_confirmed_morphs id_unique_operators mut_score mut_pivot mut_total da_score da_dark_posts da_baseline sh_score sh_confirmed sh_rotated
rc_score rc_hijacked_posts rc_career_hijackers cc_score cc_professional cc_total_tracked""".split()

#: Figures that are words, and what they say without an engine's rows; numbers are 0 then.
WORDS = {"contagion_direction": "NONE"}


def figures(frames: list[tuple[DataFrame, dict[str, Column]]], names: list[str] | None = None) -> DataFrame:
    """One row of `names`. frames: rows of an engine and the aggregates that are its figures.

    Every frame is read once for all its figures and leaves one row, which becomes (figure, number, word); all
    those meet in one aggregate, so frames are never joined. Figures without a frame, and null ones, are 0 or
    their word of WORDS; one that no name asks for is an error.
    """
    names = names or FIGURES
    unknown = {n for _, wanted in frames for n in wanted} - set(names)
    if unknown:
        raise ValueError(f"not among the figures: {sorted(unknown)}")

    def long(rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
        one = rows.agg(*[c.alias(n) for n, c in wanted.items()])
        entry = lambda n: F.struct(F.lit(n).alias("figure"), F.col(n).cast("double").alias("number") if n not in WORDS else F.lit(None).cast("double").alias("number"), F.col(n).cast("string").alias("word") if n in WORDS else F.lit(None).cast("string").alias("word"))
        return one.select(F.inline(F.array(*[entry(n) for n in wanted])))

    every = reduce(DataFrame.union, [long(rows, wanted) for rows, wanted in frames])
    pick = lambda n, c: F.max(F.when(F.col("figure") == n, F.col(c)))
    return every.agg(*[(F.coalesce(pick(n, "word"), F.lit(WORDS[n])) if n in WORDS else F.coalesce(pick(n, "number"), F.lit(0.0))).alias(n) for n in names])


def attributed_operators(comments: DataFrame, bots: DataFrame, suspects: DataFrame | None = None, least_posts: int = 2, least_bots: int = 2, dense: bool | None = None) -> DataFrame:
    """Actors who are no bots (author) and stand beside at least `least_bots` bots on at least `least_posts` posts
    each: their bots, the posts that they share with them, the share of their bots that stand beside nobody
    else so often, confidence and label. With suspects (author), only those can be operators.

    Actors of fewer posts than that can be no part of a pair and leave before bots meet operators. Unknown
    authors take no part, rows that are repeated count once. Where most bots and operators meet on many posts, they are counted
    in products of blocks (dense; None: as the counts advise), else pairs come from a join on the post.
    """
    m = stored(known(comments).filter(F.col("url").isNotNull()).select("url", "author").distinct())
    busy = m.groupBy("author").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_posts).select("author")
    who = busy.join(bots.select("author", F.lit(True).alias("bot")).distinct(), "author", "left")
    # what follows reads these rows many times: they are made once
    m = stored(m.join(who, "author").select("url", "author", F.coalesce("bot", F.lit(False)).alias("bot")))
    bot = m.filter("bot").select("url", F.col("author").alias("bot"))
    other = m.filter("not bot")
    other = (other if suspects is None else stored(other.join(suspects.select("author").distinct(), "author", "left_semi"))).select("url", F.col("author").alias("operator"))
    side = lambda df, who, here: df.select(F.lit("").alias("part"), F.col(who).alias("node"), F.lit(None).cast("string").alias("tag"), F.col("url").alias("group"), F.lit(1).alias("n"), F.lit(here).alias("bot"))
    left, right = side(bot, "bot", True), side(other, "operator", False)
    if products.crowded(left, right) if dense is None else dense:
        rows = products.group_numbers(left.union(right))
        left, right = products.incidence(rows.filter("bot")), products.incidence(rows.filter("not bot"))
        k = products.block_products(left, products.partners(least_posts), "node string, k bigint", right)
        alone = k.groupBy("node").agg(F.sum("k").alias("k")).filter("k = 1").select("node", F.lit("own").alias("tag"))
        left = stored(left.drop("tag").join(alone, "node", "left"))
        met = products.block_products(left, products.company(least_posts), "node string, met bigint, tagged bigint, word bigint, mask bigint", right)
        met = met.groupBy(F.col("node").alias("operator"), "word").agg(F.sum("met").alias("bots"), F.sum("tagged").alias("own"), F.bit_or("mask").alias("mask"))
        o = met.groupBy("operator").agg(F.sum("bots").alias("bots"), F.sum("own").alias("own"), F.sum(F.bit_count("mask")).alias("posts")).filter(F.col("bots") >= least_bots)
    else:
        pairs = bot.join(other, "url").groupBy("bot", "operator").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= least_posts)
        alone = pairs.groupBy("bot").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select("bot", F.lit(1).alias("own"))
        o = pairs.join(alone, "bot", "left").groupBy("operator").agg(F.count(F.lit(1)).alias("bots"), F.count("own").alias("own")).filter(F.col("bots") >= least_bots)
        posts = pairs.join(bot, "bot").join(other, ["operator", "url"]).groupBy("operator").agg(F.count_distinct("url").alias("posts"))
        o = o.join(posts, "operator")
    o = o.withColumn("exclusivity", F.bround(F.col("own") / F.col("bots"), 3))
    confidence = F.floor(F.bround(F.least(F.lit(100), 5 * F.col("posts")) * 0.5 + 50 * F.col("exclusivity"), 9)).cast("int")
    o = o.withColumn("confidence", F.least(F.lit(100), confidence))
    label = F.when(F.col("confidence") >= 70, "CONFIRMED").when(F.col("confidence") >= 40, "LIKELY").otherwise("POSSIBLE")
    return o.select("operator", "bots", "posts", "exclusivity", "confidence", label.alias("operation"))


def attribution_score(operators: DataFrame, most: int = 15, most_bots: int = 20) -> DataFrame:
    """One row on the report's first `most` operators: how many, and the score: 8 a confirmed one (50 at most), 5 for each of their
    bots on average (50 at most; a report names `most_bots`)."""
    shown = F.least(F.lit(most_bots), "bots")
    top = operators.withColumn("shown", shown).orderBy(F.desc("confidence"), F.desc("shown"), "operator").limit(most)
    points = F.least(F.lit(50.0), 8.0 * F.count_if(F.col("operation") == "CONFIRMED")) + F.least(F.lit(50.0), F.coalesce(5.0 * F.avg("shown"), F.lit(0.0)))
    return top.agg(F.count(F.lit(1)).alias("operators"), F.bround(points, 1).alias("score"))


def contagion_direction(negative: DataFrame, positive: DataFrame, bar: float = 0.15) -> DataFrame:
    """One row. Both frames as `timing.contagion` gives them, their tone the share of negative and of positive comments:
    whether the posts' mean share afterwards (during, where no post has an afterwards) rose by the bar over the mean share before, which is 0 where
    no post has one."""

    def rise(windows: DataFrame, name: str) -> DataFrame:
        return windows.agg((F.coalesce(F.avg("post"), F.avg("during")) - F.coalesce(F.avg("pre"), F.lit(0.0))).alias(name))

    n, p = F.bround("negative", 9) >= bar, F.bround("positive", 9) >= bar
    j = rise(negative, "negative").crossJoin(rise(positive, "positive"))  # one row each
    return j.select(F.when(n & p, "MIXED").when(n, "NEGATIVE").when(p, "POSITIVE").otherwise("NONE").alias("direction"))


def rotated_actors(cohorts: DataFrame, shifts: DataFrame) -> DataFrame:
    """cohorts (cohort, author), shifts (cohort, next, shift) -> authors of a cohort before a shift who are gone after it."""
    s = shifts.filter("shift <> 'NONE'").select("cohort", "next")
    before = s.join(cohorts.select("cohort", "author"), "cohort").select("next", "author")
    return before.join(cohorts.select(F.col("cohort").alias("next"), "author"), ["next", "author"], "left_anti").select("author").distinct()


def narrative_clusters(rows: DataFrame, clusters: DataFrame, bots: DataFrame, key: str, least: int = 3, bar: float = 0.5) -> DataFrame:
    """Clusters (key, cluster) of at least `least` rows: size, the share of rows by bots (author), and a label."""
    r = rows.select(key, "author").join(clusters.select(key, "cluster"), key).join(bots.select("author", F.lit(1.0).alias("bot")).distinct(), "author", "left")
    c = r.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.bround(F.avg(F.coalesce("bot", F.lit(0.0))), 3).alias("bot_share")).filter(F.col("size") >= least)
    return c.withColumn("label", F.when(F.col("bot_share") >= bar, "BOT_DOMINATED").when(F.col("bot_share") > 0, "MIXED").otherwise("ORGANIC"))


def narrative_roles(rows: DataFrame, clusters: DataFrame, bots: DataFrame, key: str, least: int = 3, amplifier: int = 3, soldier: int = 1) -> DataFrame:
    """Actors of clusters of at least `least` rows: in how many, and AMPLIFIER (in `amplifier` and more), SOLDIER (a bot in no more than `soldier`) or
    ORGANIC."""
    r = rows.select(key, "author").join(clusters.select(key, "cluster"), key)
    big = r.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least).select("cluster")
    a = r.join(big, "cluster", "left_semi").groupBy("author").agg(F.count_distinct("cluster").alias("clusters"))
    a = a.join(bots.select("author", F.lit(True).alias("bot")).distinct(), "author", "left")
    role = F.when(F.col("clusters") >= amplifier, "AMPLIFIER").when((F.col("clusters") <= soldier) & F.col("bot"), "SOLDIER").otherwise("ORGANIC")
    return a.select("author", "clusters", role.alias("role"))


def narrative_score(clusters: DataFrame, roles: DataFrame) -> DataFrame:
    """One row: 20 a cluster that bots dominate (60 at most), 4 an amplifier and 2 a soldier (20 at most each)."""
    c = clusters.agg(F.count_if(F.col("label") == "BOT_DOMINATED").alias("dominated"))
    r = roles.agg(F.count_if(F.col("role") == "AMPLIFIER").alias("amplifiers"), F.count_if(F.col("role") == "SOLDIER").alias("soldiers"))
    points = F.least(F.lit(60.0), 20.0 * F.col("dominated")) + F.least(F.lit(20.0), 4.0 * F.col("amplifiers")) + F.least(F.lit(20.0), 2.0 * F.col("soldiers"))
    return c.crossJoin(r).withColumn("score", F.bround(points, 1))  # one row each


def injection_score(narratives: DataFrame, most: int = 20, least: int = 40) -> DataFrame:
    """narratives as `text.injected_narratives` gives them -> one row: the report's first `most` of at least `least` points; 5 each (50 at most), the
    first one's size by 3 (30 at most) and posts by 5 (20 at most). Equal scores go by cluster."""
    top = narratives.filter(F.col("score") >= least).orderBy(F.desc("score"), "cluster").limit(most)
    first = F.max_by(F.struct("size", "posts"), F.struct("score", -F.col("cluster")))
    a = top.agg(F.count(F.lit(1)).alias("narratives"), first.alias("first"))
    points = F.least(F.lit(50.0), 5.0 * F.col("narratives")) + F.least(F.lit(30.0), 3.0 * F.col("first.size")) + F.least(F.lit(20.0), 5.0 * F.col("first.posts"))
    return a.select("narratives", F.bround(F.when(F.col("narratives") > 0, points).otherwise(0.0), 1).alias("score"))


def topology_score(ranks: DataFrame, influence: DataFrame, coordination: DataFrame, most: int = 25) -> DataFrame:
    """ranks: one row (gini) of the PageRank; influence (node, influence, suspect); coordination: one row (coordination) -> one row: 40 for the
    Gini coefficient, 35 for the share of suspects among the `most` most influential, 25 for the graph's coordination of 99."""
    top = influence.orderBy(F.desc("influence"), "node").limit(most).agg(F.coalesce(F.avg(F.col("suspect").cast("double")), F.lit(0.0)).alias("share"))
    j = ranks.select("gini").crossJoin(top).crossJoin(coordination.select("coordination"))  # one row each
    return j.select("gini", F.bround("share", 4).alias("suspect_share"), F.bround(F.least(F.lit(100.0), 40 * F.col("gini") + 35 * F.col("share") + 25 * F.col("coordination") / 99), 1).alias("score"))
