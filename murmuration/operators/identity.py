"""Actors who come back under another name: fingerprints of their writing, a table of them that outlives sessions, and an
exact join of like ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from murmuration.operators.actors import known
from murmuration.plans.checkpoints import stored

# Words that attack, and the patterns that are counted
ATTACKS = "pendejo puta corrupto ladrón ladron ratero imbécil imbecil pinche culero maldito fuera renuncia asesino narco traidor".split()
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}]"
MARKS = r"""[!?¡¿.,;:…–—"'()\[\]{}]"""
CAPITALS = "[A-ZÁÉÍÓÚÜÑ]{2,}"
#: The eight features in their order.
FEATURES = ["vocabulary", "length", "capitals", "emoji", "marks", "attacks", "digits", "rhythm"]


def fingerprints(comments: DataFrame, least: int = 5, bots: DataFrame | None = None) -> DataFrame:
    """comments (author, text) -> (author, n, fingerprint) of eight shares from 0 to 1: different words, mean words of a comment by 50,
    words in capitals, emoji by comment, marks by ten characters, attacking words by comment, digits by five
    characters, and the deviation of the comments' words by 20.

    Actors of fewer than `least` comments with text are left out unless `bots` (author) names them. Null and blank texts and unknown
    authors don't count; a space stands between two comments of an actor.
    """
    t = known(comments).withColumn("t", F.trim("text")).filter(F.char_length("t") > 0)
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[^\s\x{85}\p{Z}]+"), F.lit(0))
    runs = F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    count = lambda p: F.regexp_count("t", F.lit(p))
    t = t.select(
        "author", words.alias("ws"), F.size(words).alias("n_words"), F.char_length("t").alias("chars"), count(EMOJI).alias("emoji"), count(MARKS).alias("marks"), count(r"\d").alias("digits"),
        F.size(F.filter(runs, lambda w: w.rlike(f"^{CAPITALS}$"))).alias("capitals"), F.size(F.filter(runs, lambda w: F.lower(w).isin(*ATTACKS))).alias("attacks"),
    )
    kinds = t.select("author", F.explode("ws").alias("w")).groupBy("author").agg(F.count_distinct("w").alias("kinds"))
    g = t.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("n_words").alias("spread"), *[F.sum(c).alias(c) for c in ("n_words", "chars", "emoji", "marks", "digits", "capitals", "attacks")])
    g = g.join(kinds, "author", "left").withColumn("chars", F.col("chars") + F.col("n") - 1)
    if bots is None:
        g = g.filter(F.col("n") >= least)
    else:
        g = g.join(bots.select("author", F.lit(True).alias("bot")).distinct(), "author", "left").filter((F.col("n") >= least) | F.col("bot"))
    one = lambda c: F.bround(F.least(F.lit(1.0), c), 4)
    n, n_words = F.col("n"), F.greatest("n_words", F.lit(1))
    parts = [F.bround(F.coalesce("kinds", F.lit(0)) / n_words, 4), one(F.col("n_words") / n / 50), one(F.col("capitals") / n_words), one(F.col("emoji") / n)]
    parts += [one(F.col("marks") / F.col("chars") * 10), one(F.col("attacks") / n), one(F.col("digits") / F.col("chars") * 5), one(F.col("spread") / 20)]
    return g.select("author", "n", F.array(*[p.cast("double") for p in parts]).alias("fingerprint"))


def remember(spark: SparkSession, path: str, found: DataFrame, campaign: str, session: str) -> int:
    """Adds fingerprints of a campaign's session to the table at `path` and returns how many are new: a row that an actor
    already has for this campaign and session stays, so that a repeated run adds nothing. The table is divided by
    campaign: what is compared with a campaign's own rows doesn't read them."""
    new = found.select(F.lower(F.trim("author")).alias("normal"), "author", "n", "fingerprint", F.lit(session).alias("session"), F.lit(campaign.strip().upper()).alias("campaign"))
    new = new.filter(F.col("normal") != "").groupBy("normal", "session", "campaign").agg(F.min_by(F.struct("author", "n", "fingerprint"), "author").alias("x")).select("normal", "x.*", "session", "campaign")
    old = history(spark, path)
    if old is not None:
        new = new.join(old.select("normal", "session", "campaign"), ["normal", "session", "campaign"], "left_anti")
    new = stored(new)
    n = new.count()
    if n:
        new.write.partitionBy("campaign").mode("append").parquet(path)
    return n


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """The remembered fingerprints, or None before the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("normal string, author string, n bigint, fingerprint array<double>, session string, campaign string").parquet(path)


def cosine_matches(left: DataFrame, right: DataFrame, vector: str, threshold: float, dims: int = 3) -> DataFrame:
    """Rows of left with the rows of right whose `vector` has a cosine, rounded to four places, of at least `threshold` (above 0):
    columns as l and r, and cosine. Exact for vectors of any sign and of one length.

    Unit vectors of cosine t lie sqrt(2 - 2t) apart at most, so they differ by no more in any coordinate. The
    `dims` coordinates of most variance are cut to cells of that width, and rows meet the 3^dims cells around theirs only; the
    rest of the bound, the product of the norms of what the cells leave out, is checked before the whole product. Null
    vectors and those of zeros match none.
    """
    bar = threshold - 0.00005 - 1e-9  # what rounds to the threshold
    gap = max((2 - 2 * bar) ** 0.5, 1e-6)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    def unit(df: DataFrame, name: str) -> DataFrame:
        u = df.select(F.struct(*df.columns).alias(name), size(F.col(vector)).alias("norm"), F.col(vector).alias("v")).filter(F.col("norm") > 0)
        return u.select(name, F.transform("v", lambda x: x / F.greatest("norm", F.lit(1e-300))).alias(f"{name}u"))

    l, r = unit(left, "l"), unit(right, "r")  # noqa: E741
    width = l.agg(F.max(F.size("lu"))).first()[0] or 0
    if not width:  # no vectors, no pairs
        return l.join(r, F.lit(False)).select("l", "r", F.lit(0.0).alias("cosine"))
    spread = l.agg(*[F.var_pop(F.col("lu")[k]) for k in range(width)]).first()
    best = sorted(range(width), key=lambda k: (-(spread[k] or 0.0), k))[:dims]
    rest = [k for k in range(width) if k not in best]
    cell = lambda u, k: F.floor((u[k] + 1) / gap).cast("int")
    for k in best:
        l = l.withColumn(f"c{k}", F.explode(F.array(*[cell(F.col("lu"), k) + d for d in (-1, 0, 1)])))  # noqa: E741
        r = r.withColumn(f"c{k}", cell(F.col("ru"), k))
    dot = lambda ks: sum((F.col("lu")[k] * F.col("ru")[k] for k in ks), F.lit(0.0))
    norm = lambda u: F.sqrt(sum((F.col(u)[k] * F.col(u)[k] for k in rest), F.lit(0.0)))
    met = l.withColumn("lrest", norm("lu")).join(r.withColumn("rrest", norm("ru")), [f"c{k}" for k in best])
    met = met.filter(dot(best) + F.col("lrest") * F.col("rrest") >= bar).withColumn("cosine", F.bround(dot(range(width)), 4))
    return met.filter(F.col("cosine") >= threshold).select("l", "r", "cosine")


def level(cosine: Column) -> Column:
    return F.when(cosine >= 0.92, "CONFIRMED").when(cosine >= 0.85, "PROBABLE").otherwise("POSSIBLE")


def morphs(current: DataFrame, past: DataFrame, threshold: float = 0.75) -> DataFrame:
    """current and past (author, fingerprint, campaign): pairs of different names (case and blanks apart) of other campaigns whose fingerprints
    are alike, with their level and the features that differ by less than .08."""
    p = cosine_matches(current, past, "fingerprint", threshold)
    p = p.filter((F.lower(F.trim("l.author")) != F.lower(F.trim("r.author"))) & (F.upper(F.trim("l.campaign")) != F.upper(F.trim("r.campaign"))))
    same = F.filter(F.transform(F.arrays_zip(F.col("l.fingerprint").alias("x"), F.col("r.fingerprint").alias("y"), F.array(*map(F.lit, FEATURES)).alias("name")), lambda z: F.when(F.abs(z["x"] - z["y"]) < 0.08, z["name"])), lambda x: x.isNotNull())
    return p.select(F.col("l.author").alias("now"), F.col("r.author").alias("was"), F.col("r.campaign").alias("campaign"), "cosine", level(F.col("cosine")).alias("identity"), F.array_join(F.slice(same, 1, 5), ",").alias("alike"))


def persistence(current: DataFrame, pairs: DataFrame, top: int = 20) -> DataFrame:
    """One row from the `top` likest pairs (ties by names): actors, confirmed and probable pairs, operators left once confirmed ones
    count with their other name, and a score of 25 a confirmed and 10 a probable pair and 20 times the mean cosine, 100 at most."""
    best = pairs.orderBy(F.desc("cosine"), "now", "was", "campaign").limit(top)
    b = best.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("identity") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("identity") == "PROBABLE").alias("probable"), F.avg("cosine").alias("mean"))
    j = current.agg(F.count(F.lit(1)).alias("actors")).crossJoin(b)  # one row each
    score = F.when(F.col("pairs") > 0, F.least(F.lit(100.0), 25.0 * F.col("confirmed") + 10.0 * F.col("probable") + 20 * F.col("mean"))).otherwise(0.0)
    return j.select("actors", "pairs", "confirmed", "probable", F.when(F.col("actors") > 0, F.greatest(F.lit(1), F.col("actors") - F.col("confirmed"))).otherwise(0).cast("bigint").alias("operators"), F.bround(score, 1).alias("score"))
