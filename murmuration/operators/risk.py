"""Signals, fused scores and evidence. Scores come with what they rest on and with an abstention band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.plans.joins import numbered

#: Weights of the fused dimensions (fixed values, in order; they sum to 0.99).
WEIGHTS = {
    "troll_hunter": 0.22, "cib_graph": 0.16, "temporal": 0.13, "narrative_mut": 0.09, "dark_amp": 0.07, "engagement": 0.07,
    "contagion": 0.05, "reply_chain": 0.04, "bot_farm_shift": 0.03, "cross_campaign": 0.02, "identity": 0.01, "psi_core": 0.10,
}


def level(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MODERATE").when(score >= 20, "LOW").otherwise("ORGANIC")


def fuse(scores: DataFrame, weights: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """scores (by..., dimension, score): one row for each `by`: fused score, label, data quality, active dimensions.

    Scores are clamped to [0, 100]. The weight of dimensions that are missing or zero goes to the active
    ones in proportion. Fewer than one active dimension is INSUFFICIENT and forces the label ORGANIC.
    """
    w = weights or WEIGHTS
    spark, by = scores.sparkSession, by or []
    table = F.broadcast(spark.createDataFrame(list(w.items()), "dimension string, weight double"))
    s = scores.join(table, "dimension").withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0)))))
    live = F.col("s") > 0
    a = s.groupBy(*by).agg(F.sum(F.when(live, F.col("s") * F.col("weight")).otherwise(0.0)).alias("sw"), F.sum(F.when(live, F.col("weight")).otherwise(0.0)).alias("w"), F.count_if(live).alias("active"))
    total = float(sum(w.values()))
    fused = F.bround(F.when(F.col("w") > 0, F.col("sw") / F.col("w") * total).otherwise(0.0), 1)
    a = a.withColumn("fused", fused)
    quality = F.when(F.col("active") >= 3, "SUFFICIENT").when(F.col("active") >= 1, "LOW").otherwise("INSUFFICIENT")
    label = F.when(F.col("active") < 1, F.lit("ORGANIC")).otherwise(level(F.col("fused")))
    return a.select(*by, "fused", "active", quality.alias("quality"), label.alias("label"))


#: Signals of an actor: points, and severity (fixed values, in order).
SIGNALS = {"page_account": (22, "HIGH"), "multi_page": (25, "CRITICAL"), "aggression": (22, "HIGH"), "reach": (18, "HIGH"), "velocity": (18, "HIGH"), "wave": (20, "CRITICAL"), "copy_paste": (20, "CRITICAL"), "name": (15, "MEDIUM")}


def actor_risk(signals: DataFrame) -> DataFrame:
    """signals (author, signal, value 0 to 1): risk 0 to 100 = 100 * sum(value * points) / 170; two critical signals lift
    it to 60, three to 75."""
    spark = signals.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, p, s) for k, (p, s) in SIGNALS.items()], "signal string, points int, severity string"))
    s = signals.filter(F.col("value") > 0).groupBy("author", "signal").agg(F.max("value").alias("value")).join(table, "signal")
    a = s.groupBy("author").agg(F.sum(F.least(F.col("value"), F.lit(1.0)) * F.col("points")).alias("sum"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.array_sort(F.collect_set("signal")).alias("signals"))
    base = F.bround(100 * F.col("sum") / 170, 0)
    risk = F.least(F.lit(100.0), F.when(F.col("critical") >= 3, F.greatest(base, F.lit(75.0))).when(F.col("critical") >= 2, F.greatest(base, F.lit(60.0))).otherwise(base)).cast("int")
    return a.select("author", risk.alias("risk"), level(risk).alias("risk_label"), "critical", "signals")


def suspect_score(attacks: Column, posts: Column, name_points: Column, copycat: Column) -> Column:
    """0 to 99: attacks 30, posts 40, name 15, copying 15."""
    s = 30 * F.least(attacks / 20, F.lit(1.0)) + 40 * F.least(posts / 5, F.lit(1.0)) + 15 * name_points / 100 + F.when(copycat, 15).otherwise(0)
    return F.least(F.lit(99), s.cast("int"))


def comment_signals(comments: DataFrame, copies: DataFrame, attack: Column, name_points: Column) -> DataFrame:
    """comments with id, and copies (id): points per comment (copy 70, name up to 35, template 45, capitals 30, no likes 20)
    and a label: 65 confirmed, 35 suspicious."""
    from murmuration.functions.text import caps_ratio

    c = comments.join(copies.select("id", F.lit(True).alias("copied")).distinct(), "id", "left")
    points = (
        F.when(F.coalesce("copied", F.lit(False)), 70).otherwise(0) + F.least(F.floor(name_points / 2), F.lit(35)) + F.when(attack, 45).otherwise(0)
        + F.when(caps_ratio(F.col("text")) > 0.55, 30).otherwise(0) + F.when(attack & (F.col("likes") == 0) & (F.length("text") > 10), 20).otherwise(0)
    )
    c = c.withColumn("points", F.least(points, F.lit(100)))
    return c.withColumn("comment_label", F.when(F.col("points") >= 65, "CONFIRMED").when(F.col("points") >= 35, "SUSPICIOUS").otherwise("ORGANIC"))


def post_signals(posts: DataFrame, copies: DataFrame) -> DataFrame:
    """posts and copies (url, most): points for ghosts, silent posts and near copies, and a label: 60 confirmed, 30 suspicious."""
    p = posts.join(copies.groupBy("url").agg(F.max("most").alias("most")), "url", "left")
    r, s, c = F.col("reactions"), F.col("shares"), F.col("comments_count")
    points = F.when((r <= 3) & (s > r), 50).otherwise(0) + F.when((r + s + c == 0) & (F.length("text") > 20), 55).otherwise(0) + F.when(F.col("most").isNotNull(), F.least(F.lit(85), (100 * F.col("most")).cast("int") + 20)).otherwise(0)
    p = p.withColumn("points", F.least(points, F.lit(100)))
    return p.withColumn("post_label", F.when(F.col("points") >= 60, "CONFIRMED").when(F.col("points") >= 30, "SUSPICIOUS").otherwise("ORGANIC"))


def evidence_chain(signals: DataFrame, least: int = 20, most: int = 12) -> DataFrame:
    """signals (author, signal, points, severity 1 highest): per actor the sum and at most `most` signals by severity."""
    r = F.row_number().over(W.partitionBy("author").orderBy("severity", F.desc("points"), "signal"))
    s = signals.withColumn("r", r)
    total = s.groupBy("author").agg(F.sum("points").alias("points"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "signal", "points")))).alias("chain"))
    return total.filter(F.col("points") >= least).select("author", F.least("points", F.lit(100)).alias("confidence"), F.transform("chain", lambda x: F.concat_ws(":", x["signal"], x["points"].cast("string"))).alias("chain"))


def evidence_manifest(items: DataFrame, case_id: str) -> DataFrame:
    """items (category, key, detail): numbered items with the SHA-256 of their fields joined by '|'. The number is the
    item's place by category and key."""
    i = numbered(items, ["category", "key", "detail"], "item")
    number = F.col("item").cast("string")
    i = i.withColumn("item_id", F.concat(F.lit(f"{case_id}-"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")))).drop("item")
    return i.withColumn("item_hash", F.sha2(F.concat_ws("|", "category", "key", "detail"), 256))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted item hashes, so that the order of items plays no part."""
    joined = F.array_join(F.array_sort(F.collect_list("item_hash")), "")
    return manifest.agg(F.count(F.lit(1)).alias("items"), F.sha2(joined, 256).alias("manifest_hash"))
