"""Collection rules, orders, merges and page texts: what stands between a saved page and the engines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.functions.parse import human_number
from murmuration.functions.text import word_shingles
from murmuration.plans.joins import range_self_join

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


# --- rows that stay


def ingest_cutoff(posts: DataFrame, cutoff_us: Column) -> DataFrame:
    """Posts that are not older than the cutoff; one without a time stays."""
    return posts.filter(F.col("us").isNull() | (F.col("us") >= cutoff_us))


def most_liked(comments: DataFrame, most: int = 300, floor: int = 50) -> DataFrame:
    """Of every post the comments of most likes, `most` of them but never fewer than the floor; ties by place."""
    by = W.partitionBy("url").orderBy(F.desc("likes"), "pos")
    return comments.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= max(floor, most)).drop("r")


def first_of(rows: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Of rows of equal keys the first by the order; a hot key is reduced before it is shuffled."""
    named = [F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(keys)]
    t = rows.select(F.struct(*rows.columns).alias("row"), F.struct(*order).alias("at"), *named)
    return t.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.min_by("row", "at").alias("row")).select("row.*")


def distinct_comments(comments: DataFrame) -> DataFrame:
    """Comments of a post that open alike (80 characters) count once."""
    return first_of(comments, ["url", F.substring("text", 1, 80)], ["pos"])


def distinct_by_actor(comments: DataFrame) -> DataFrame:
    """One comment for each actor, post and opening (60 characters of lower case, blanks squeezed)."""
    opening = F.substring(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 1, 60)
    return first_of(comments, ["author", "url", opening], ["pos"])


def discovered(pages: DataFrame, names: list[str]) -> DataFrame:
    """pages (id, text) -> (id, name) where at least half of a name's words stand in the text. names are the caller's."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    hits = []
    for name in names:
        parts = sorted(set(name.lower().split()))
        hits.append(F.when(2 * F.size(F.array_intersect("ws", F.array(*map(F.lit, parts)))) >= len(parts), F.lit(name)))
    t = pages.select("id", words.alias("ws"))
    return t.select("id", F.explode(F.array_compact(F.array(*hits))).alias("name")) if names else t.select("id", F.lit("").alias("name")).limit(0)


def has_context(post: Column, comment: Column) -> Column:
    """Whether a comment (words of four letters and more) shares a word with its post (of five and more)."""
    words = lambda c, n: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"\p{{L}}{{{n},}}"), F.lit(0))
    return F.arrays_overlap(words(post, 5), words(comment, 4))


def query_list(given: list[str]) -> list[str]:
    """Queries of repeated options and comma lists, in order, each once."""
    return list(dict.fromkeys(q.strip() for x in given for q in x.split(",") if q.strip()))


def mode_filter(posts: DataFrame, mode: str) -> DataFrame:
    """Posts whose label belongs to a mode; unknown modes are the negative one."""
    kinds = {"negative": ["NEGATIVO", "AGRESIVO"], "aggressive": ["AGRESIVO"], "positive": ["POSITIVO"], "neutral": ["NEUTRAL"]}
    return posts if mode == "all" else posts.filter(F.col("label").isin(*kinds.get(mode, kinds["negative"])))


# --- orders


def mode_order(posts: DataFrame, mode: str) -> DataFrame:
    """By the mode's score, then engagement, then place."""
    score = {"aggressive": "aggressive_score", "positive": "positive_score", "neutral": "neutral_score"}.get(mode, "negative_score")
    return posts.orderBy(F.desc(score), F.desc("engagement_total"), "pos")


def status_order(deltas: DataFrame) -> DataFrame:
    """Changes of actors by importance, then by how much their score moved."""
    rank = F.array_position(F.array(*map(F.lit, ["NEW_BOT", "SCORE_UP", "DISAPPEARED", "SCORE_DOWN", "STABLE"])), F.col("status"))
    return deltas.orderBy(F.when(rank == 0, 9).otherwise(rank), F.desc(F.abs("delta")), "author")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the different values of a key in the order in which they first occur."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def most_common(rows: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """(value, n): the k values of most rows; ties by the first place."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k)


# --- merges


def union_sources(*sources: DataFrame) -> DataFrame:
    """Posts of several sources under one set of columns; what a source lacks is null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def with_deep_comments(posts: DataFrame, deep: DataFrame, top: int) -> DataFrame:
    """The `top` posts of most engagement take the count of their deep comments (url, found); others keep their own."""
    best = posts.orderBy(F.desc("engagement_total"), "pos").limit(top).select("url", F.lit(True).alias("deep"))
    j = posts.join(best, "url", "left").join(deep.select("url", "found"), "url", "left")
    return j.withColumn("comments_count", F.when(F.col("deep"), F.coalesce("found", "comments_count")).otherwise(F.col("comments_count"))).drop("deep", "found")


def with_confidence(suspects: DataFrame, confidence: DataFrame) -> DataFrame:
    """Suspects with their human confidence (author, hcs, hcs_band); 50 and "?" where there is none."""
    return suspects.join(confidence.select("author", "hcs", "hcs_band"), "author", "left").fillna({"hcs": 50, "hcs_band": "?"})


def mention_targets(replies: DataFrame, organic: DataFrame) -> DataFrame:
    """replies (url, author, mention) of bots, organic (url, author): (author, target, attackers): whom bots address by
    name. A mention stands for the first organic author of the post whose name contains it."""
    m = replies.filter(F.col("mention").isNotNull() & (F.trim("mention") != "")).select("url", F.col("author").alias("attacker"), F.lower(F.trim("mention")).alias("mention")).distinct()
    o = organic.select("url", F.col("author").alias("target")).distinct()
    j = m.join(o, "url").filter(F.contains(F.lower("target"), F.col("mention")))
    first = j.groupBy("url", "attacker", "mention").agg(F.min("target").alias("target"))
    return first.groupBy("url", "target").agg(F.count_distinct("attacker").alias("attackers"), F.lit(30).alias("intensity"))


def post_bursts(posts: DataFrame, width_min: int = 90, least: int = 3, bar: float = 0.15) -> DataFrame:
    """posts (url, pos, source, text, us; pos tells them apart): anchors that at least `least` - 1 like posts of other sources follow within the
    width, one per starting minute: that of most posts, ties to the earlier one."""
    t = posts.filter(F.col("us").isNotNull()).select("url", "pos", "source", "us", F.array_distinct(word_shingles(F.col("text"), 3)).alias("grams"))
    t = t.withColumn("n", F.size("grams"))
    # like posts share an n-gram: only those that two posts have meet, on narrow rows, and are counted by pair
    grams = t.select("pos", "source", "us", "n", F.explode("grams").alias("gram")).withColumn("gram", F.xxhash64("gram", F.length("gram")))
    met = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "gram", "left_semi")
    other = lambda a, b: (a("source") != b("source")) & ((a("us") < b("us")) | (a("pos") < b("pos")))
    shared = range_self_join(met, "us", width_min * MINUTE, ["gram"], other).groupBy("a_pos", "b_pos", "a_n", "b_n").agg(F.count(F.lit(1)).alias("shared"))
    near = shared.filter(F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared")) >= bar)
    end = lambda x, *more: t.select(*[F.col(c).alias(f"{x}_{c}") for c in ("pos", "us", *more)])
    near = near.join(end("a", "url"), "a_pos").join(end("b", "source"), "b_pos")
    g = near.groupBy("a_url", "a_us", "a_pos").agg((F.count(F.lit(1)) + 1).alias("posts"), F.max("b_us").alias("end_us"), (F.count_distinct("b_source") + 1).alias("sources")).filter(F.col("posts") >= least)
    g = g.select(F.floor(F.col("a_us") / MINUTE).alias("start_min"), F.struct((-F.col("posts")).alias("posts"), F.col("a_us").alias("us"), F.col("a_pos").alias("pos")).alias("rank"), F.struct(F.col("a_url").alias("url"), "posts", "sources", F.bround((F.col("end_us") - F.col("a_us")) / MINUTE, 0).cast("int").alias("span_min")).alias("b"))
    return g.groupBy("start_min").agg(F.min_by("b", "rank").alias("b")).select("start_min", "b.*")


def burst_ratio(posts: DataFrame, comments: DataFrame, now_us: Column, share: float = 0.20) -> DataFrame:
    """posts (url, us): the share of a post's comments that came in the first `share` of its age; of fewer than three: 0."""
    p = posts.select("url", F.col("us").alias("post_us"), (F.greatest((now_us - F.col("us")) / HOUR, F.lit(0.1)) * HOUR * share).alias("early"))
    j = comments.select("url", "us").join(p, "url")
    a = j.groupBy("url").agg(F.count(F.lit(1)).alias("comments"), F.count_if(F.col("us") <= F.col("post_us") + F.col("early")).alias("early"))
    return a.withColumn("burst_ratio", F.when(F.col("comments") >= 3, F.bround(F.col("early") / F.col("comments"), 4)).otherwise(0.0))


# --- summaries


def naming_profile(actors: DataFrame, by: list[str]) -> DataFrame:
    """actors (by..., author): shares of names with digits, short (to 6) and medium (to 12) ones, and of openings (four
    letters of the first word) that more than one name has."""
    name = F.trim("author")
    solid = F.char_length(F.replace("author", F.lit(" "), F.lit("")))
    t = actors.select(*by, F.substring(F.lower(F.regexp_extract(name, r"^(\S+)", 1)), 1, 4).alias("opening"), F.col("author").rlike(r"\d").cast("int").alias("digits"), (solid <= 6).cast("int").alias("short"), ((solid > 6) & (solid <= 12)).cast("int").alias("medium"))
    o = t.groupBy(*by, "opening").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("digits", "short", "medium")])
    all_ = F.sum("n")
    return o.groupBy(*by).agg(all_.alias("names"), *[(F.sum(c) / all_).alias(f"{c}_share") for c in ("digits", "short", "medium")], (F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("common_share"))


PROFILE = ["digits_share", "short_share", "medium_share", "common_share"]


def naming_similarity(a: dict[str, str] | str = "a", b: str = "b") -> Column:
    """1 minus the mean difference of two profiles, given as structs."""
    return F.bround(1 - sum((F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in PROFILE), F.lit(0.0)) / len(PROFILE), 3)


def registry_counts(seen: DataFrame) -> DataFrame:
    """One row: actors, campaigns, appearances, and actors of two campaigns and more."""
    per = seen.groupBy("author").agg(F.count_distinct("campaign").alias("k"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("actors"), F.sum("n").alias("appearances"), F.count_if(F.col("k") >= 2).alias("recurring")).crossJoin(seen.agg(F.count_distinct("campaign").alias("campaigns")))  # one row each


def fingerprints_of(table: DataFrame, campaign, current: bool = True) -> DataFrame:
    """Fingerprints of a campaign, or the latest of every actor in all others."""
    if current:
        return table.filter(F.col("campaign") == campaign)
    return table.filter(F.col("campaign") != campaign).groupBy("author").agg(F.max_by(F.struct(*table.columns), "campaign").alias("row")).select("row.*")


def campaign_start(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: the earliest post's time, or the earliest comment's where no post has one."""
    return posts.agg(F.min("us").alias("p")).crossJoin(comments.agg(F.min("us").alias("c"))).select(F.coalesce("p", "c").alias("start_us"))  # one row each


def mean_of_window_means(windows: DataFrame) -> DataFrame:
    """windows (url, slot, mean, n): per slot the unweighted mean of the posts' means, and all comments."""
    return windows.groupBy("slot").agg(F.bround(F.avg("mean"), 4).alias("mean"), F.sum("n").alias("n"))


def session_trend(delta: DataFrame, drift: Column, change_pct: Column) -> DataFrame:
    """delta (status per actor) of two sessions -> one row: new bots, escalations, score of change, trend."""
    a = delta.agg(F.count_if(F.col("status") == "NEW_BOT").alias("new_bots"), F.count_if(F.col("status") == "SCORE_UP").alias("escalations")).withColumn("drift", drift).withColumn("change_pct", change_pct)
    points = 5 * F.col("new_bots") + F.when(F.col("drift") == "MAJOR_PIVOT", 25).when(F.col("drift") == "MODERATE_DRIFT", 10).otherwise(0) + F.when(F.col("change_pct") > 30, 20).when(F.col("change_pct") < -30, -20).otherwise(0) + 3 * F.col("escalations")
    score = F.least(F.lit(40.0), 4.0 * F.col("new_bots")) + F.when(F.col("drift") == "MAJOR_PIVOT", 30.0).when(F.col("drift") == "MODERATE_DRIFT", 15.0).otherwise(0.0) + F.least(F.lit(20.0), F.abs("change_pct") * 0.3) + F.least(F.lit(10.0), 2.0 * F.col("escalations"))
    trend = F.when(F.col("points") >= 40, "ESCALATING").when(F.col("points") <= -20, "DECLINING").when(F.abs("points") < 15, "STABLE").otherwise("EVOLVING")
    return a.withColumn("points", points).withColumn("delta_score", F.bround(F.least(F.lit(100.0), score), 1)).withColumn("trend", trend)


# --- texts of pages

#: Interface words that mark a line as no content (fixed values).
UI_NOISE = [
    "me gusta", "comentar", "compartir", "ver más", "seguir", "suscribir", "iniciar sesión", "registrarse", "like", "comment", "share", "subscribe",
    "sign in", "log in", "react", "reply", "see more", "traducir", "ocultar", "denunciar", "guardar", "etiquetas", "publicidad",
]


def content_lines(text: Column, least: int = 20, most: int = 20) -> Column:
    """The lines of content of a page's text in one: long enough, no interface words, no bare counts; `most` of them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    noisy = lambda x: F.exists(F.array(*map(F.lit, UI_NOISE)), lambda w: F.contains(F.lower(x), w))
    good = F.filter(lines, lambda x: (F.char_length(x) >= least) & ~noisy(x) & ~x.rlike(r"^[\d\s.,KMkmil]+$"))
    return F.array_join(F.slice(good, 1, most), " ")


NUMBER = r"([\d\s.,]+(?:\s*mil(?:lones?)?)?\s*[KMk]?)"
#: What stands behind (or before) a count of each kind (fixed values, in order).
ENGAGEMENT = {
    "reactions": [NUMBER + r"\s*(?:reacciones?|reactions?|me gusta|likes?)", NUMBER + r"\s*(?:personas?\s+reaccionaron)"],
    "comments": [NUMBER + r"\s*(?:comentarios?|comments?)"],
    "shares": [NUMBER + r"\s*(?:veces?|compartidos?|shares?)", r"compartido\s+" + NUMBER + r"\s*(?:veces?)?"],
}


def engagement_of(text: Column) -> Column:
    """struct<reactions, comments, shares> from a post's visible text: the first pattern with a count above zero."""
    out = []
    for kind, patterns in ENGAGEMENT.items():
        counts = [human_number(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + p, 1)) for p in patterns]
        out.append(F.coalesce(*[F.when(c > 0, c) for c in counts], F.lit(0)).cast("long").alias(kind))
    return F.struct(*out)


#: Forms of a comment's relative time (fixed values, in order): pattern, seconds.
COMMENT_TIMES = [
    (r"^(\d+)\s*s(?:eg)?\.?$", 1), (r"^(\d+)\s*min(?:utos?)?\.?$", 60), (r"^(\d+)\s*h(?:r|rs|oras?)?\.?$", 3600), (r"^(\d+)\s*d(?:ías?|ias?|ays?)?\.?$", 86400),
    (r"^(\d+)\s*w(?:ks?|eeks?)\.?$", 604800), (r"^(\d+)\s*semanas?\.?$", 604800), (r"^hace\s+(\d+)\s+seg", 1), (r"^hace\s+(\d+)\s+min", 60), (r"^hace\s+(\d+)\s+hora", 3600),
    (r"^hace\s+(\d+)\s+d[íi]a", 86400), (r"^hace\s+(\d+)\s+semana", 604800),
]
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12, "jan": 1, "apr": 4, "aug": 8}


def comment_micros(text: Column, now_us: Column) -> Column:
    """A comment's time against a reference instant: relative forms, yesterday at noon, '12 de mayo de 2024 a las 9:30'
    (without a year that of now, without an hour noon); what stands behind a dot is dropped; else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[·•\s]+", ""), r"\s*[·•]\s*.+$", "")
    out = F.lit(None).cast("long")
    day = F.floor(now_us / DAY) * DAY
    absolute = r"(?i)(\d{1,2})\s+de?\s+(\w+)(?:\s+de?\s+(\d{4}))?(?:\s+a\s+las?\s+(\d{1,2}):(\d{2}))?"
    part = lambda k: F.regexp_extract(t, absolute, k)
    number = lambda k, other: F.coalesce(part(k).try_cast("int"), other)
    month = F.element_at(F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.substring(part(2), 1, 3)))
    year = F.year(F.timestamp_micros(now_us).cast("timestamp_ntz").cast("date"))
    written = F.concat_ws("-", F.lpad(number(3, year).cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")
    at = F.unix_date(written).cast("long") * DAY + number(4, F.lit(12)) * HOUR + number(5, F.lit(0)) * MINUTE
    sane = month.isNotNull() & (number(4, F.lit(12)) < 24) & (number(5, F.lit(0)) < 60)
    found = F.when(t.rlike(r"(?i)^(ayer|yesterday)$"), day - DAY + 12 * HOUR)
    for pattern, seconds in COMMENT_TIMES:
        found = found.when(t.rlike("(?i)" + pattern), now_us - F.regexp_extract(t, "(?i)" + pattern, 1).try_cast("long") * seconds * 1_000_000)
    found = found.when(t.rlike(absolute) & sane, at)
    return F.when(t == "", out).otherwise(found)


def first_time(lines: Column, now_us: Column, scan: int = 4) -> Column:
    """The first time that one of the first lines holds."""
    return F.get(F.array_compact(F.transform(F.slice(lines, 1, scan), lambda x: comment_micros(x, now_us))), F.lit(0))


def vote(text: Column, negative: list[str], positive: list[str]) -> Column:
    """-1, 0 or 1: whether more negative or more positive patterns are found."""
    n, p = (sum((F.coalesce(text, F.lit("")).rlike("(?i)" + x).cast("int") for x in xs), F.lit(0)) for xs in (negative, positive))
    return F.when(n > p, -1).when(p > n, 1).otherwise(0)


def short_name(name: Column, most: int = 28) -> Column:
    """A name cut to `most` characters, the last of which tells that it was cut."""
    n = F.trim(name)
    return F.when(F.char_length(n) <= most, n).otherwise(F.concat(F.substring(n, 1, most - 1), F.lit("…")))


def sequence_ratios(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `ratio`, 2 * matching characters / all, by longest common blocks taken recursively. A kernel on bounded
    batches: SQL's edit distance is another measure."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for t in batches:
            yield t.assign(ratio=[round(SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(t[a], t[b], strict=True)])

    return pairs.mapInPandas(run, f"{schema}, ratio double")


# --- sentiment

#: Words that turn or strengthen what follows, and slang with its meaning (fixed values).
NEGATION = ["no", "ni", "nunca", "jamás", "jamas", "tampoco", "sin", "nada", "nadie", "ningún", "ningun"]
INTENSIFIER = ["muy", "súper", "super", "demasiado", "totalmente", "completamente", "absolutamente", "bien", "bastante", "extremadamente", "re"]
SLANG = {"hdp": "hijo de puta", "q": "que", "jtp": "a la cárcel"}


def sentiment(rows: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text", negators: list[str] | None = None, boosters: list[str] | None = None) -> DataFrame:
    """lexicon (phrase, dimension neg, pos or agg, score; small: it is the caller's list) -> key, negative_score, positive_score, aggressive_score, label,
    triggers (eight at most, phrases of several words first).

    A word counts 0.55 of its score behind a negator among the four before, else 1.45 behind an intensifier among the two
    before, 1.3 times as much where the text's word of the same place is in capitals (three and more); phrases
    count as they are. Aggression adds 0.4 of itself to the negative. Sums are divided by 12 and capped at 1; 0.15 of
    aggression, then negative, then positive gives the label.
    """
    negators, boosters = negators or NEGATION, boosters or INTENSIFIER
    low = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))))
    for short, long in SLANG.items():
        low = F.regexp_replace(low, rf"(?U)\b{short}\b", long)
    t = rows.select(*key, low.alias("low"), F.split(low, r"(?U)\W+").alias("ws"), F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " ").alias("said"))
    single, several = (lexicon.filter(F.contains("phrase", F.lit(" ")) == flag) for flag in (False, True))
    w = t.select(*key, "ws", "said", F.posexplode("ws").alias("i", "word")).join(F.broadcast(single), F.col("word") == F.col("phrase"))
    back = lambda n: F.slice("ws", F.greatest(F.lit(1), F.col("i") - (n - 1)), F.least(F.col("i"), F.lit(n)))
    hit = lambda n, xs: F.arrays_overlap(back(n), F.array(*map(F.lit, xs)))
    loud = F.coalesce(F.get("said", F.col("i")), F.lit(""))
    loud = (loud == F.upper(loud)) & (loud != F.lower(loud)) & (F.char_length(loud) > 2)
    value = F.col("score") * F.when(hit(4, negators), 0.55).when(hit(2, boosters), 1.45).otherwise(1.0) * F.when(loud, 1.3).otherwise(1.0)
    found = w.select(*key, "dimension", "phrase", F.col("i").alias("at"), value.alias("value"))
    phrases = several.groupBy().agg(F.collect_list(F.struct("phrase", "dimension", "score")).alias("listed"))  # the caller's list in one row
    p = t.select(*key, "low").crossJoin(F.broadcast(phrases)).select(*key, F.explode(F.filter("listed", lambda x: F.contains(F.col("low"), x["phrase"]))).alias("x"))
    found = found.unionByName(p.select(*key, "x.dimension", "x.phrase", F.lit(-1).alias("at"), F.col("x.score").alias("value")))
    side = lambda d: F.sum(F.when(F.col("dimension") == d, F.col("value")).otherwise(0.0))
    first = found.groupBy(*key, "phrase").agg(F.min("at").alias("at"), *[side(d).alias(d) for d in ("neg", "pos", "agg")])
    norm = lambda c: F.bround(F.least(F.lit(1.0), c / 12), 3)
    s = first.groupBy(*key).agg(norm(F.sum(F.col("neg") + 0.4 * F.col("agg"))).alias("neg"), norm(F.sum("pos")).alias("pos"), norm(F.sum("agg")).alias("agg"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "phrase"))), 1, 8), lambda x: x["phrase"]).alias("triggers"))
    s = rows.select(*key).distinct().join(s, key, "left").fillna(0.0, ["neg", "pos", "agg"]).withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))
    s = s.withColumnsRenamed({"neg": "negative_score", "pos": "positive_score", "agg": "aggressive_score"})
    return s.withColumn("label", F.when(F.col("aggressive_score") >= 0.15, "AGRESIVO").when(F.col("negative_score") >= 0.15, "NEGATIVO").when(F.col("positive_score") >= 0.15, "POSITIVO").otherwise("NEUTRAL"))
