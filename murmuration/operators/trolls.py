"""Risk of single actors from eight signals that are computed from their comments, and the chain of evidence of all engines.

The signal of a name's origin has no table and no weight here: a name is no evidence. The look-up itself is generic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.operators.actors import known
from murmuration.plans.checkpoints import stored

# Patterns of insults, of memes and of attacking words, generic names, weights of the signals
INSULTS = (
    "pend[e3]j[o0a]|puta|pinch[e3]|cabr[o0ó]n|mam[o0ó]n|idi[o0]ta|mier[d]a|bast[a]rdo|inútil|corrupto|ratero|ladrón|ladron|mentiroso|traidor|asesino|prosti|puta|guey|wey|chinga|hijo de|chinga tu|"
    "te la p[e3]las?|muerto de hambre|mal[pa]rido|malandrin|malandro|te chinga|vete al|p[e3]lo[t]udo|cagad[ao]|lamecul[oa]s|hipócrita|hipocrita|farsante|estafador|joto|culero|vergon|"
    "naco|narc[oa]|sicario|corrupta|corrupto|roba|roban|robando"
)
MEMES = "jaja|jeje|lol|xd+|😂|🤣|🤡|💩|😆|😝|👆|🖕|haha|kek|lmao|🐷|🐀|🐍|🦠|💀|☠️|🤮|🤢"
ATTACKS = (
    "fuera|renuncia|dimite|corrupto|ladrón|ratero|mentira|mentiroso|tramposo|asesino|roba|roban|criminal|delincuente|narco|sicario|vendido|traidor|hypócrita|inútil|inepto|"
    "incompetente|basta|ya basta|que se vaya|que renuncie"
)
GENERIC = "^(user|cuenta|perfil|test|admin|anonimo|anónimo)\\d*$"
WEIGHTS = {"S1_NAME": 30, "S2_PAGE": 22, "S3_MULTI": 25, "S4_AGG": 22, "S5_CROSS": 18, "S6_VEL": 18, "S7_COORD": 20, "S8_PROFILE": 15}
PERSONAL_MIDDLES = "de del la los las san carlos jose juan maria".split()
SEVERITIES = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def _words(pattern: str) -> str:
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])({pattern})(?![\p{{L}}\p{{N}}_])"


def page_score(name: Column, keywords: list[str], least_words: int = 3, capitals: int = 3) -> Column:
    """0 to 1: how much a name looks like that of a page: .55 for a keyword, .20 or .25 for many words, .20 for a word in capitals,
    .15 for a digit."""
    n = F.trim(name)
    parts = F.filter(F.split(n, r"\s+"), lambda w: F.length(w) > 0)
    personal = (F.size(parts) == 2) | ((F.size(parts) == 3) & F.lower(F.try_element_at(parts, F.lit(2))).isin(*PERSONAL_MIDDLES))
    keyword = n.rlike(_words("|".join(r"\Q" + k + r"\E" for k in sorted(keywords, key=lambda k: (-len(k), k))))) if keywords else F.lit(False)
    many = F.when((F.size(parts) >= least_words) & ~personal, 0.20).when(F.size(parts) >= 5, 0.25).otherwise(0.0)
    score = F.when(keyword, 0.55).otherwise(0.0) + many + F.when(n.rlike(rf"(?<![\p{{L}}\p{{N}}_])[A-ZÁÉÍÓÚÜÑ]{{{capitals},}}(?![\p{{L}}\p{{N}}_])"), 0.20).otherwise(0.0) + F.when(n.rlike(r"\d"), 0.15).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.when(F.char_length(n) >= 2, score).otherwise(0.0)), 2)


def name_lookup(names: DataFrame, table: DataFrame, name: str = "author") -> DataFrame:
    """table (part, place, label, confidence, priority), place one of first, last, any, prefix, suffix -> (name, label, confidence,
    matched) of the row of least priority that a name meets; of equal ones the longest part, then the least.

    A prefix or suffix belongs to the last word, which has to be longer than four characters and than itself. Parts of names and of the
    table meet in one equi-join; affixes are listed only in the lengths that the table has. Names that meet nothing have no
    row; the table's rows are compared in lower case.
    """
    t = table.select(F.lower("part").alias("part"), "place", "label", "confidence", "priority")
    sizes = {r.place: sorted(r.sizes) for r in t.filter(F.col("place").isin("prefix", "suffix")).groupBy("place").agg(F.collect_set(F.char_length("part")).alias("sizes")).collect()}
    n = names.select(F.col(name).alias("name")).filter(F.length(F.trim("name")) > 0).distinct()
    n = n.withColumn("ws", F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: F.length(w) > 0)).withColumn("last", F.element_at("ws", -1))
    entry = lambda place, part: F.struct(F.lit(place).alias("place"), part.alias("part"))
    single = F.size("ws") == 1
    keys = [F.transform("ws", lambda w: entry("any", w)), F.array(entry("first", F.element_at("ws", 1))), F.when(single, F.array().cast("array<struct<place:string,part:string>>")).otherwise(F.array(entry("last", F.col("last"))))]
    long_ = F.char_length("last")
    for place, lengths in sizes.items():
        cut = (lambda k: F.substring("last", 1, k)) if place == "prefix" else (lambda k: F.right("last", F.lit(k)))
        keys.append(F.filter(F.array(*[F.when((long_ > 4) & (long_ > k), entry(place, cut(k))) for k in lengths]), lambda x: x.isNotNull()))
    met = n.select("name", F.explode(F.concat(*keys)).alias("k")).select("name", "k.place", "k.part").distinct().join(t, ["place", "part"])
    best = F.min(F.struct("priority", (-F.char_length("part")).alias("size"), "part", "label", "confidence"))
    return met.groupBy("name").agg(best.alias("b")).select("name", "b.label", "b.confidence", F.col("b.part").alias("matched"))


def actor_signals(comments: DataFrame, waves: DataFrame, copies: DataFrame, linked: DataFrame, keywords: list[str], insults: str = INSULTS, memes: str = MEMES, attacks: str = ATTACKS) -> DataFrame:
    """comments (author, url, text, us), actors in waves (author), with copied texts (author), linked pages (node, leader) -> (author, signal,
    value, weight, severity), the signals S2 to S8 of every actor with a comment:

    a page by its name; a leader of two other pages and more; aggression, from half of a third of insults, memes and attacks by comment or any
    insult or meme; three posts and more; seven comments an hour and more over at least .08 hours; a wave or copied texts; digits,
    a single long word or a generic name. Comments without text don't count. One pass over the comments counts all that they say.
    """
    c = known(comments).filter(F.length("text") > 0)
    hit = lambda p: F.count_if(F.col("text").rlike(p))
    a = c.groupBy("author").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("posts"), F.count("us").alias("timed"), ((F.max("us") - F.min("us")) / 3.6e9).alias("span_h"),
        hit(_words(insults)).alias("insults"), hit(f"(?i)({memes})").alias("memes"), hit(_words(attacks)).alias("attacks"),
    )
    a = a.join(waves.select("author", F.lit(True).alias("wave")).distinct(), "author", "left").join(copies.select("author", F.lit(True).alias("copied")).distinct(), "author", "left")
    pages = linked.filter("node <> leader").groupBy(F.col("leader").alias("author")).agg(F.count_distinct("node").alias("pages"))
    a = a.join(pages, "author", "left").withColumn("page", page_score(F.col("author"), keywords))
    aggression = F.least(F.lit(1.0), (F.col("insults") + F.col("memes") + F.col("attacks")) / (F.col("n") * 3))
    cph = F.when(F.col("timed") >= 2, F.bround(F.col("timed") / F.greatest(F.col("span_h"), F.lit(0.08)), 2)).otherwise(0.0)
    name = F.col("author")
    odd = name.rlike(r"\d{2,}") | (~F.contains(F.trim(name), F.lit(" ")) & (F.char_length(name) >= 5)) | F.lower(name).rlike(GENERIC)
    two = lambda top, high, v: F.when(v >= top, "CRITICAL").when(v >= high, "HIGH").otherwise("MEDIUM")
    rules = [
        ("S2_PAGE", F.col("page") >= 0.40, F.col("page"), F.lit("HIGH")),
        ("S3_MULTI", F.col("pages") >= 2, F.least(F.lit(1.0), F.col("pages") / 5), F.lit("CRITICAL")),
        ("S4_AGG", (aggression >= 0.5) | (F.col("insults") + F.col("memes") > 0), aggression, two(0.8, 0.5, aggression)),
        ("S5_CROSS", F.col("posts") >= 3, F.least(F.lit(1.0), F.col("posts") / 10), two(5, 3, F.col("posts"))),
        ("S6_VEL", cph >= 7, F.least(F.lit(1.0), cph / 20), two(15, 7, cph)),
        ("S7_COORD", F.col("wave") | F.col("copied"), F.when(F.col("copied"), 0.85).otherwise(0.75), F.lit("CRITICAL")),
        ("S8_PROFILE", odd, F.lit(0.6), F.lit("MEDIUM")),
    ]
    listed = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(k).alias("signal"), v.cast("double").alias("value"), F.lit(WEIGHTS[k]).alias("weight"), s.alias("severity"))) for k, on, v, s in rules])
    return a.select("author", "n", "posts", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("s")).select("author", "n", "posts", "s.*")


def classify(score: Column) -> Column:
    return F.when(score >= 80, "CONFIRMED_BOT").when(score >= 60, "HIGH_RISK").when(score >= 40, "SUSPICIOUS").when(score >= 20, "LIKELY_HUMAN").otherwise("HUMAN")


def actor_profiles(signals: DataFrame) -> DataFrame:
    """signals as `actor_signals` gives them -> (author, comments, risk, classification, critical, signals): the weighted sum by the sum of all
    weights, raised to 60 by two critical signals and to 75 by three."""
    g = signals.groupBy("author").agg(F.max("n").alias("comments"), F.sum(F.col("value") * F.col("weight")).alias("raw"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.array_sort(F.collect_set("signal")).alias("signals"))
    base = F.least(F.lit(100.0), F.bround(F.bround(F.col("raw") / sum(WEIGHTS.values()) * 100, 9), 0))
    risk = F.when(F.col("critical") >= 3, F.greatest(base, F.lit(75.0))).when(F.col("critical") >= 2, F.greatest(base, F.lit(60.0))).otherwise(base).cast("int")
    return g.select("author", "comments", risk.alias("risk"), classify(risk).alias("classification"), "critical", F.array_join("signals", ",").alias("signals"))


def hunt_score(profiles: DataFrame, top: int = 50) -> DataFrame:
    """One row over the `top` riskiest actors (then those of most comments, then by name): counts by class and the score, 60 for the share of
    confirmed ones and half the mean risk, 40 at most."""
    p = profiles.orderBy(F.desc("risk"), F.desc("comments"), "author").limit(top)
    count = lambda c: F.count_if(F.col("classification") == c)
    a = p.agg(F.count(F.lit(1)).alias("actors"), count("CONFIRMED_BOT").alias("confirmed"), count("HIGH_RISK").alias("high_risk"), count("SUSPICIOUS").alias("suspicious"), F.avg("risk").alias("mean"))
    score = F.when(F.col("actors") > 0, F.least(F.lit(100.0), 60.0 * F.col("confirmed") / F.greatest("actors", F.lit(1)) + F.least(F.lit(40.0), 0.5 * F.col("mean")))).otherwise(0.0)
    return a.select("actors", "confirmed", "high_risk", "suspicious", F.bround(score, 1).alias("score"))


# --- the chain of evidence


def evidence(signals: DataFrame, velocity: DataFrame | None = None, waves: DataFrame | None = None, clones: DataFrame | None = None, copies: DataFrame | None = None, confidence: DataFrame | None = None,
             campaigns: DataFrame | None = None, morphs: DataFrame | None = None, hijacks: DataFrame | None = None, shifts: DataFrame | None = None) -> DataFrame:
    """(author, signal, points, severity) of all engines in one table, so that they need no join by actor: signals as `actor_signals` gives
    them, velocity (author, velocity_label), waves (author, wave), clones (author, other), copies (author), confidence (author, hcs), campaigns
    (author, classification), morphs (now, identity), hijacks (author, hijacks), shifts (author). Absent engines add nothing; what an engine
    says of an actor more than once counts once, clones and copies twice together."""
    row = lambda df, code, points, severity, author="author": df.select(F.col(author).alias("author"), F.lit(code).alias("signal"), points.cast("int").alias("points"), severity.alias("severity"))
    crit = lambda on, a, b: (F.when(on, a).otherwise(b), F.when(on, "CRITICAL").otherwise("HIGH"))
    parts = [signals.select("author", "signal", F.col("weight").cast("int").alias("points"), "severity")]
    if velocity is not None:
        on = F.col("velocity_label") == "BOT_VELOCITY"
        parts.append(row(velocity.filter(F.col("velocity_label").isin("BOT_VELOCITY", "SUSPICIOUS")), "N4_VEL", *crit(on, 20, 12)))
    if waves is not None:
        per = waves.groupBy("author").agg(F.count_distinct("wave").alias("k"))
        parts.append(row(per, "E7_TW", *crit(F.col("k") >= 3, 18, 12)))
    style = []
    if clones is not None:
        style.append(row(clones.groupBy("author", "other").agg(F.lit(1).alias("k")), "E1_SF", F.lit(15), F.lit("HIGH")))
    if copies is not None:
        style.append(row(copies.select("author"), "E1_CP", F.lit(12), F.lit("HIGH")))
    if style:
        at = F.row_number().over(W.partitionBy("author").orderBy(F.desc("signal"), "points"))
        parts.append(reduce(DataFrame.union, style).withColumn("r", at).filter("r <= 2").drop("r"))
    if confidence is not None:
        low = confidence.filter("hcs < 40")
        parts.append(row(low, "HCS_LOW", F.lit(10), F.when(F.col("hcs") < 20, "HIGH").otherwise("MEDIUM")))
    if campaigns is not None:
        parts.append(row(campaigns, "E6_CC", *crit(F.col("classification") == "PROFESSIONAL", 20, 14)))
    if morphs is not None:
        best = morphs.groupBy("now").agg(F.min(F.when(F.col("identity") == "CONFIRMED", 0).otherwise(1)).alias("k"))
        parts.append(row(best, "E1_ID", *crit(F.col("k") == 0, 18, 12), author="now"))
    if hijacks is not None:
        parts.append(row(hijacks.filter("hijacks >= 2"), "E2_RH", F.lit(12), F.lit("HIGH")))
    if shifts is not None:
        parts.append(row(shifts.select("author").distinct(), "E7_BS", F.lit(10), F.lit("HIGH")))
    return reduce(DataFrame.union, parts)


def chains(found: DataFrame, profiles: DataFrame, least_risk: int = 20, most: int = 12) -> DataFrame:
    """found as `evidence` gives it, profiles (author, risk, classification) -> per actor of at least that risk: its `most` gravest signals, by
    severity and points, then by name. Profiles travel in the same table, so one shuffle by actor folds everything."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in SEVERITIES.items()], F.lit(9))
    said = found.select("author", F.struct(rank.alias("rank"), (-F.col("points")).alias("points"), "signal").alias("s"), F.lit(None).cast("int").alias("risk"), F.lit(None).cast("string").alias("classification"))
    who = profiles.filter(F.col("risk") >= least_risk).select("author", F.lit(None).cast(said.schema["s"].dataType).alias("s"), "risk", "classification")
    g = said.union(who).groupBy("author").agg(F.max("risk").alias("risk"), F.max("classification").alias("classification"), F.array_sort(F.collect_list("s")).alias("s")).filter(F.col("risk").isNotNull())
    chain = F.slice("s", 1, most)
    return g.select("author", "risk", "classification", F.size(chain).alias("signals"), F.array_join(F.transform(chain, lambda x: F.concat_ws(":", x["signal"], (-x["points"]).cast("string"))), ",").alias("chain"))


def linked_pages(comments: DataFrame, keywords: list[str], least: float = 0.45) -> DataFrame:
    """(node, leader): pages by their names that share a post and the words of their comments (`coordination.paired_accounts`)."""
    from murmuration.operators.coordination import paired_accounts
    from murmuration.operators.groups import page_groups

    pages = stored(known(comments).filter(page_score(F.col("author"), keywords) >= 0.40).select(F.col("author").alias("page"), "url", "text"))
    return page_groups(paired_accounts(pages, least))
