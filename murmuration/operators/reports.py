"""Aggregates behind reports: key figures, timelines, attack kinds, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.functions.text import title, tokens


def key_figures(*campaigns: tuple[str, DataFrame]) -> DataFrame:
    """One row of all campaign frames' figures (one row each), their columns under the frame's name."""
    rows = [df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns]) for name, df in campaigns]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # of one row each


def source_totals(posts: DataFrame, label: str = "label") -> DataFrame:
    """Per source: posts, negative and aggressive ones, engagement."""
    return posts.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col(label) == "NEGATIVE").alias("negative"), F.count_if(F.col(label) == "AGGRESSIVE").alias("aggressive"), F.sum("engagement").alias("engagement"))


def post_timeline(posts: DataFrame, most: int = 8) -> DataFrame:
    """The earliest posts of different titles, a report of `most` rows."""
    p = posts.filter(F.col("us").isNotNull()).withColumn("title", title(F.col("text")))
    first = F.row_number().over(W.partitionBy(F.lower("title")).orderBy("us", "pos"))
    return p.withColumn("n", first).filter("n = 1").orderBy("us", "pos").limit(most).select("us", "pos", "title")


def attack_kinds(rows: DataFrame, kinds: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Per kind of attack: rows that hold any of its words (lower case), and their share of all rows."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    flags = F.array(*[F.when(hit(words), F.lit(name)) for name, words in kinds.items()])
    n = rows.agg(F.count(F.lit(1)).alias("all"))
    k = rows.select(F.explode(F.array_compact(flags)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return k.crossJoin(F.broadcast(n)).select("kind", "n", F.bround(100 * F.col("n") / F.col("all"), 2).alias("share"))


def priority_bands(rows: DataFrame, score: str) -> DataFrame:
    """Rows by band of a priority score: 65 urgent, 40 high, 18 watch, else low."""
    s = F.col(score)
    band = F.when(s >= 65, "URGENT").when(s >= 40, "HIGH").when(s >= 18, "WATCH").otherwise("LOW")
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(score), 2).alias("mean"))


def attack_density(comments: DataFrame, attack: Column) -> DataFrame:
    """Per post: comments, attacks and their share."""
    return comments.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.count_if(attack).alias("attacks"), F.bround(F.avg(attack.cast("double")), 4).alias("density"))


def repeat_attackers(comments: DataFrame, attack: Column, least: int = 2) -> DataFrame:
    """Actors that attack on at least `least` posts."""
    a = comments.filter(attack).groupBy("author").agg(F.count(F.lit(1)).alias("attacks"), F.count_distinct("url").alias("posts"))
    return a.filter(F.col("posts") >= least)


def shared_terms(rows: DataFrame, least_sources: int, text: str = "text", least_letters: int = 4) -> DataFrame:
    """Terms that at least so many sources use."""
    t = rows.select("source", F.explode(tokens(F.col(text), least_letters)).alias("term")).distinct()
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("sources")).filter(F.col("sources") >= least_sources)


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Mean of value by weight; no weight at all gives 0."""
    total = F.sum(weight)
    return rows.groupBy(*by).agg(F.bround(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0), 4).alias("mean"), total.alias("weight"))


def adaptive_threshold(pairs: DataFrame, similarity: str, k: float = 1.0, low: float = 0.3, high: float = 0.9) -> DataFrame:
    """One row: mean + k population deviations of the similarities, clamped."""
    bar = F.greatest(F.lit(low), F.least(F.lit(high), F.avg(similarity) + k * F.stddev_pop(similarity)))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.bround(F.coalesce(bar, F.lit(low)), 4).alias("threshold"))


def recurrent_actors(membership: DataFrame, least: int = 3) -> DataFrame:
    """membership (slice, author, community): actors that clusters of at least `least` slices of time hold."""
    return membership.groupBy("author").agg(F.count_distinct("slice").alias("slices")).filter(F.col("slices") >= least)


def monitor_summary(cycles: DataFrame, time: str) -> DataFrame:
    """cycles as `streaming.cycles` gives them -> one row: cycles, posts, alerts, the grave ones, the highest score, the last alert's time."""
    return cycles.agg(
        F.count(F.lit(1)).alias("cycles"), F.sum("posts").alias("posts"), F.count("alert").alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"), F.bround(F.max("score"), 1).alias("most_score"), F.max(F.when(F.col("alert").isNotNull(), F.col(time))).alias("last_alert"),
    )
