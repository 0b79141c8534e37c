"""Operators on single actors: posting rate, life cycle, first movers, name and text habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.plans.kernels import greedy_windows

HOUR = 3_600_000_000


def known(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("author").isNotNull() & (F.col("author") != "?"))


def span_hours(first: str = "first_us", last: str = "last_us") -> Column:
    return (F.col(last) - F.col(first)) / F.lit(float(HOUR))


def profiles(comments: DataFrame) -> DataFrame:
    """author, n_comments, n_posts, first_us, last_us of comments with a time."""
    t = comments.filter(F.col("us").isNotNull())
    return t.groupBy("author").agg(F.count(F.lit(1)).alias("n_comments"), F.count_distinct("url").alias("n_posts"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def velocity(comments: DataFrame, min_comments: int = 2, floor_h: float = 0.25, bot: float = 15, suspicious: float = 7) -> DataFrame:
    """Posting rate of every actor with a label and a score of 0 to 100."""
    p = profiles(comments).filter(F.col("n_comments") >= min_comments).withColumn("span_h", span_hours())
    p = p.withColumn("cph", F.bround(F.col("n_comments") / F.greatest(F.col("span_h"), F.lit(floor_h)), 2))
    cph = F.col("cph")
    label = F.when(cph >= bot, "BOT_VELOCITY").when(cph >= suspicious, "SUSPICIOUS").otherwise("NORMAL")
    score = F.when(cph >= bot, F.least(F.lit(100), (60 + (cph - bot) * 2).cast("int"))).when(cph >= suspicious, (30 + (cph - suspicious) * 30 / 8).cast("int")).otherwise((cph * 30 / suspicious).cast("int"))
    return p.select("author", "n_comments", "n_posts", F.bround("span_h", 4).alias("span_h"), "cph", label.alias("velocity_label"), score.cast("int").alias("velocity_score"))


def velocity_campaign(v: DataFrame) -> DataFrame:
    """One row: shares of the labels and the campaign's score."""
    a = v.agg(F.count(F.lit(1)).alias("actors"), F.count_if(F.col("velocity_label") == "BOT_VELOCITY").alias("bots"), F.count_if(F.col("velocity_label") == "SUSPICIOUS").alias("suspicious"), F.coalesce(F.max("cph"), F.lit(0.0)).alias("max_cph"))
    share = F.when(F.col("actors") > 0, F.col("bots") / F.col("actors")).otherwise(0.0)
    return a.withColumn("score", F.bround(F.least(F.lit(100.0), 60 * share + F.least(F.lit(40.0), 1.5 * F.col("max_cph"))), 1))


def lifecycle(comments: DataFrame, min_comments: int = 3) -> DataFrame:
    """Time to activation, first half hour, rate and reach of every actor; points add up to a role."""
    t = known(comments).filter(F.col("us").isNotNull())
    by = W.partitionBy("author")
    t = t.withColumn("first", F.min("us").over(by)).withColumn("early", (F.col("us") <= F.col("first") + HOUR // 2).cast("int"))
    p = t.groupBy("author").agg(F.count(F.lit(1)).alias("n_comments"), F.count_distinct("url").alias("n_posts"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("early").alias("burst"))
    start = t.agg(F.min("us").alias("start_us"))
    p = p.filter(F.col("n_comments") >= min_comments).crossJoin(F.broadcast(start))
    p = p.withColumn("lag_h", (F.col("first_us") - F.col("start_us")) / F.lit(float(HOUR))).withColumn("active_h", span_hours())
    p = p.withColumn("cph", F.col("n_comments") / F.greatest(F.col("active_h"), F.lit(0.5)))
    point = lambda when, n: F.when(when, n).otherwise(0)
    points = (
        point((F.col("lag_h") >= 0) & (F.col("lag_h") < 2), 30) + point(F.col("burst") >= 3, 20) + point(F.col("cph") >= 10, 25)
        + point((F.col("n_posts") == 1) & (F.col("n_comments") >= 5), 15) + point((F.col("active_h") > 0) & (F.col("active_h") < 0.5), 10)
    )
    p = p.withColumn("points", F.least(points, F.lit(100)))
    role = F.when(F.col("points") >= 75, "SLEEPER").when((F.col("cph") >= 10) & (F.col("points") >= 40), "BURST").when((F.col("n_posts") >= 3) & (F.col("points") >= 35), "COORDINATOR").otherwise("ORGANIC")
    return p.select("author", "n_comments", "n_posts", "burst", F.bround("lag_h", 3).alias("lag_h"), F.bround("cph", 3).alias("cph"), "points", role.alias("role"), "first_us")


def sleeper_cells(actors: DataFrame, width: int = HOUR, least: int = 3) -> DataFrame:
    """Groups of actors (author, first_us) first seen within one width, found greedily from the left; only islands
    that no longer gap divides reach the sequential kernel."""
    return greedy_windows(actors.select("author", F.col("first_us").alias("us"), F.lit(0).alias("pos")), width, least, least_authors=1, merge_gap=None)


def first_movers(comments: DataFrame, n: int = 5) -> DataFrame:
    """The first n timed comments of every post that has as many: url, author, us, place."""
    t = known(comments).filter(F.col("us").isNotNull())
    by = W.partitionBy("url")
    t = t.withColumn("place", F.row_number().over(by.orderBy("us", "pos"))).withColumn("all", F.count(F.lit(1)).over(by))
    return t.filter((F.col("place") <= n) & (F.col("all") >= n)).select("url", "author", "us", "place")


def seed_profiles(movers: DataFrame, least: int = 3) -> DataFrame:
    p = movers.groupBy("author").agg(F.count_distinct("url").alias("posts"), F.bround(F.avg("place"), 2).alias("mean_place"))
    return p.withColumn("is_seed", F.col("posts") >= least)


def seed_pairs(movers: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of actors that are among the first on at least `least` posts; each post has few movers."""
    m = movers.select("url", "author").distinct()
    pairs = m.select("url", F.col("author").alias("a")).join(m.select("url", F.col("author").alias("b")), "url").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("posts")).filter(F.col("posts") >= least)


def name_score(name: Column, generic: list[str], keywords: list[str]) -> Column:
    """0 to 100: how much a name looks made up. Lists are lower case; 40 and more counts as suspicious."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    low, solid = F.lower(n), F.replace(n, F.lit(" "), F.lit(""))
    # words of letters alone; others are no part of a personal name
    words = F.filter(F.split(low, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    rules = [
        (n.rlike(r"\d{3,}"), 35), ((n == F.upper(n)) & (F.char_length(n) > 3), 25), (F.char_length(solid) <= 4, 20), (solid.rlike(r"^\d+$"), 60),
        (F.regexp_count(n, F.lit(r"[^\p{L}\p{N}_\s,.]")) >= 2, 20), ((F.size(words) >= 2) & (F.size(F.array_distinct(words)) < F.size(words)), 20),
    ]
    total = F.lit(0)
    for rule, points in rules:
        total = total + F.when(rule, points).otherwise(0)
    total = total + F.when((F.size(words) == 1) & words[0].isin(*generic), 30).otherwise(0) if generic else total
    total = total + F.when(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)), 40).otherwise(0) if keywords else total
    return F.least(total, F.lit(100))


def style_features(comments: DataFrame, least: int = 1) -> DataFrame:
    """Text habits of every actor: mean words and characters, marks per character, vocabulary."""
    t = known(comments).filter(F.length(F.trim("text")) > 0)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    t = t.select("author", F.char_length("text").alias("chars"), words.alias("words"), *[F.regexp_count("text", F.lit(p)).alias(c) for c, p in (("marks", r"[.,;:!?]"), ("capitals", r"\p{Lu}"), ("accents", r"[àáâãäåèéêëìíîïòóôõöùúûüçñÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑ]"), ("excl", "!"), ("quest", r"\?"), ("dots", r"\.\.\."))])
    base = t.groupBy("author").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("words")).alias("n_words"), F.sum("chars").alias("n_chars"), *[F.sum(c).alias(c) for c in ("marks", "capitals", "accents", "excl", "quest", "dots")])
    distinct = t.select("author", F.explode("words").alias("w")).groupBy("author").agg(F.count_distinct("w").alias("distinct_words"))
    p = base.filter(F.col("texts") >= least).join(distinct, "author", "left")
    per = lambda a, b: F.bround(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return p.select(
        "author", "texts", per("n_words", "texts").alias("mean_words"), per("n_chars", "texts").alias("mean_chars"), per("marks", "n_chars").alias("mark_rate"),
        per("capitals", "n_chars").alias("capital_rate"), per("accents", "n_chars").alias("accent_rate"), per("excl", "texts").alias("excl_rate"),
        per("quest", "texts").alias("quest_rate"), per("dots", "texts").alias("dots_rate"), F.bround(F.coalesce("distinct_words", F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1)), 4).alias("vocab_ratio"),
    )


STYLE = ["mean_words", "mean_chars", "mark_rate", "capital_rate", "accent_rate", "excl_rate", "quest_rate", "dots_rate", "vocab_ratio"]


def template_actors(style: DataFrame) -> DataFrame:
    """Actors of at least three texts with little vocabulary, or very short and shouting texts."""
    template = (F.col("texts") >= 3) & ((F.col("vocab_ratio") < 0.35) | ((F.col("mean_words") <= 4) & (F.col("excl_rate") >= 0.5)))
    return style.withColumn("style_label", F.when(template, "BOT_TEMPLATE").otherwise("HUMAN"))


def copy_paste_groups(comments: DataFrame, prefix: int = 30, least: int = 3) -> DataFrame:
    """Openings (first `prefix` characters, lower case) that at least `least` actors share."""
    t = known(comments).withColumn("opening", F.substring(F.lower(F.trim("text")), 1, prefix)).filter(F.char_length("opening") >= prefix)
    return t.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("actors"), F.count_distinct("url").alias("posts")).filter(F.col("actors") >= least)


def human_confidence(actors: DataFrame) -> DataFrame:
    """actors (author, name_points 0-100, attack_ratio, vocab_ratio, degree, pattern 0-9): 99 minus penalties, and a band.
    Missing values cost nothing."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    top = actors.agg(F.greatest(F.max(zero("degree")), F.lit(1.0)).alias("most_degree"))
    name = F.floor(zero("name_points") * 25 / 100)
    attack = F.floor(zero("attack_ratio") * 25)
    vocab = F.floor(F.lit(20) * (1 - F.coalesce(F.col("vocab_ratio").cast("double"), F.lit(1.0))))
    degree = F.floor(20 * zero("degree") / F.col("most_degree"))
    score = F.greatest(F.lit(0), 99 - F.least(name, F.lit(25)) - F.least(attack, F.lit(25)) - F.least(vocab, F.lit(20)) - degree - F.least(zero("pattern"), F.lit(9)))
    band = F.when(F.col("hcs") >= 80, "HUMAN").when(F.col("hcs") >= 60, "LIKELY_HUMAN").when(F.col("hcs") >= 40, "REVIEW").when(F.col("hcs") >= 20, "LIKELY_BOT").otherwise("BOT")
    return actors.crossJoin(F.broadcast(top)).withColumn("hcs", score.cast("int")).withColumn("hcs_band", band).drop("most_degree")  # top is one row
