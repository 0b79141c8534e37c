"""Operators on time: waves, synchronised pairs, timelines, cohorts, arrival windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.operators.actors import HOUR, known
from murmuration.plans.checkpoints import stored
from murmuration.plans.joins import range_self_join
from murmuration.plans.kernels import greedy_windows

SECOND, MINUTE = 1_000_000, 60_000_000


def attack_waves(comments: DataFrame, width_s: int = 60, least: int = 3, merge_ratio: float = 0.5) -> DataFrame:
    """Windows of at least `least` comments by two or more actors, near ones joined, with their intensity."""
    w = greedy_windows(comments, width_s * SECOND, least, 2, int(width_s * SECOND * merge_ratio))
    seconds = F.greatest((F.col("end_us") - F.col("start_us")) / SECOND, F.lit(1.0))
    return w.withColumn("intensity", F.bround(F.col("authors").cast("bigint") * F.col("events") / seconds, 3))


def wave_actors(waves: DataFrame, least: int = 2) -> DataFrame:
    """Actors of at least `least` waves."""
    a = waves.select(F.explode("actors").alias("author")).groupBy("author").agg(F.count(F.lit(1)).alias("waves"))
    return a.filter(F.col("waves") >= least)


def sync_pairs(comments: DataFrame, within_s: int = 3, same_post: bool = False) -> DataFrame:
    """Pairs of actors with comments at most within_s apart, on any posts (or on one): times and posts of the earlier."""
    c = known(comments).select("author", "us", "url", "pos")
    p = range_self_join(c, "us", within_s * SECOND, ["url"] if same_post else [], lambda a, b: (a("author") != b("author")) & ((a("us") < b("us")) | (a("pos") < b("pos"))))
    first, second = F.least("a_author", "b_author"), F.greatest("a_author", "b_author")
    return p.groupBy(first.alias("a"), second.alias("b")).agg(F.count(F.lit(1)).alias("times"), F.count_distinct("a_url").alias("posts"), F.min(F.col("b_us") - F.col("a_us")).alias("least_gap_us"))


def temporal_campaign(waves: DataFrame, pairs: DataFrame) -> DataFrame:
    w = waves.agg(F.count(F.lit(1)).alias("waves"), F.coalesce(F.avg("intensity"), F.lit(0.0)).alias("mean_intensity"))
    p = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    score = F.least(F.lit(60.0), F.col("mean_intensity") * 3 + F.col("waves") * 5) + F.least(F.lit(40.0), F.col("pairs") * 8.0)
    return w.crossJoin(p).withColumn("score", F.bround(F.least(F.lit(100.0), score), 1))


def hourly_timeline(comments: DataFrame, last: int | None = 168) -> DataFrame:
    """Comments and actors by hour; of them the last 168 with any, by default."""
    t = comments.filter(F.col("us").isNotNull()).groupBy(F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("actors"))
    return t if last is None else t.orderBy(F.desc("hour")).limit(last)


def label_pivot(comments: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per day with one column of counts for each label in `source`."""
    day = F.floor(F.col("us") / (24 * HOUR)).alias("day")
    p = comments.filter(F.col("us").isNotNull()).groupBy(day).pivot("source", labels).agg(F.count(F.lit(1)))
    return p.select("day", *[F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in labels])


def peak_density(comments: DataFrame, width_s: int = 10) -> DataFrame:
    """Per post: most comments in any forward window, and the earliest time it opens."""
    by = W.partitionBy("url").orderBy("us").rangeBetween(0, width_s * SECOND)
    t = comments.filter(F.col("us").isNotNull()).select("url", "us", F.count(F.lit(1)).over(by).alias("n"))
    return t.groupBy("url").agg(F.max("n").alias("peak"), F.max_by("us", F.struct("n", -F.col("us"))).alias("peak_us"))


def elapsed_bins(comments: DataFrame) -> DataFrame:
    """Per post and time since its first comment (0: under 2 h, 1: 6, 2: 24, 3: later): comments and mean likes."""
    t = comments.filter(F.col("us").isNotNull()).withColumn("age", F.col("us") - F.min("us").over(W.partitionBy("url")))
    slot = F.when(F.col("age") < 2 * HOUR, 0).when(F.col("age") < 6 * HOUR, 1).when(F.col("age") < 24 * HOUR, 2).otherwise(3)
    return t.groupBy("url", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))


def sentiment_delta(comments: DataFrame, vote: str = "vote", least: int = 3, bar: float = 0.20) -> DataFrame:
    """Per post: share of negative votes in the first two hours and after six, the difference and a label."""
    t = comments.filter(F.col("us").isNotNull()).withColumn("age", F.col("us") - F.min("us").over(W.partitionBy("url")))
    early, late = F.col("age") < 2 * HOUR, F.col("age") >= 6 * HOUR
    share = lambda when: F.avg(F.when(when, (F.col(vote) < 0).cast("double")))
    p = t.groupBy("url").agg(F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"), share(early).alias("neg_early"), share(late).alias("neg_late"))
    p = p.withColumn("delta", F.bround(F.coalesce("neg_early", F.lit(0.0)) - F.coalesce("neg_late", F.lit(0.0)), 4))
    label = F.when(F.col("n_early") < least, "INSUFFICIENT").when(F.col("delta") >= bar, "SEEDED").when(F.col("delta") <= -bar, "REVERSED").otherwise("STABLE")
    return p.select("url", "n_early", "n_late", "delta", label.alias("delta_label"))


def cohorts(comments: DataFrame, width_min: int = 60, least: int = 3) -> DataFrame:
    """Tumbling cohorts of actors from the first comment on, as (cohort, author, n, size); small ones are left out. Rows are dealt by author once."""
    t = known(comments).filter(F.col("us").isNotNull())
    start = t.agg(F.min("us").alias("start_us"))
    t = t.crossJoin(F.broadcast(start)).select(F.floor((F.col("us") - F.col("start_us")) / (width_min * MINUTE)).alias("cohort"), "author")
    m = t.repartition("author").groupBy("cohort", "author").agg(F.count(F.lit(1)).alias("n"))
    size = m.groupBy("cohort").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return m.join(F.broadcast(size), "cohort")  # one row a cohort


def cohort_shifts(members: DataFrame, bots: DataFrame, least_share: float = 0.40) -> DataFrame:
    """Each cohort against the next that remains: shared actors, Jaccard, turnover (the share of the later one that is
    new), the share of bots (author) in both, and the shift's level: high where both are dense with bots."""
    # one row an actor; it stays for the next cohort that remains if this is the next of its own
    of = members.groupBy("author").agg(F.array_sort(F.collect_set("cohort")).alias("own")).join(bots.select("author", F.lit(1).alias("bot")).distinct(), "author", "left")
    of = stored(of.select("own", "bot"))
    sizes = of.select(F.explode("own").alias("cohort"), "bot").groupBy("cohort").agg(F.count(F.lit(1)).alias("size"), F.bround(F.sum(F.coalesce("bot", F.lit(0))) / F.count(F.lit(1)), 4).alias("bots"))
    order = W.orderBy("cohort")  # one row per cohort
    pairs = sizes.select("cohort", "size", "bots", F.lead("cohort").over(order).alias("next"), F.lead("size").over(order).alias("next_size"), F.lead("bots").over(order).alias("next_bots")).filter(F.col("next").isNotNull())
    n = F.size("own")
    steps = of.filter(n > 1).select(F.explode(F.arrays_zip(F.slice("own", 1, n - 1).alias("cohort"), F.slice("own", 2, n - 1).alias("next"))).alias("s"))
    shared = steps.groupBy("s.cohort", "s.next").agg(F.count(F.lit(1)).alias("shared"))
    p = pairs.join(shared, ["cohort", "next"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    p = p.withColumn("jaccard", F.bround(F.col("shared") / (F.col("size") + F.col("next_size") - F.col("shared")), 4))
    p = p.withColumn("turnover", F.bround(1 - F.col("shared") / F.col("next_size"), 4))
    a, b = F.col("bots") >= least_share, F.col("next_bots") >= least_share
    both, one = a & b, a | b
    level = F.when((F.col("jaccard") <= 0.15) & both, "HIGH").when((F.col("jaccard") <= 0.30) & one, "MEDIUM").when(F.col("jaccard") <= 0.30, "LOW").otherwise("NONE")
    return p.select("cohort", "next", "size", "next_size", "shared", "jaccard", "turnover", "bots", "next_bots", level.alias("shift"))


def arrivals(comments: DataFrame, width_min: int = 15) -> DataFrame:
    """Per post: start of the densest forward window, the earliest of equals."""
    p = peak_density(comments, width_min * 60)
    return p.select("url", F.col("peak_us").alias("arrival_us"), "peak")


def contagion(comments: DataFrame, arrival: DataFrame, tone: str = "tone", bar: float = 0.15) -> DataFrame:
    """Mean tone an hour before, half an hour during and until two hours after each post's arrival, and the shift."""
    t = comments.filter(F.col("us").isNotNull()).join(arrival, "url").withColumn("d", F.col("us") - F.col("arrival_us"))
    slot = F.when((F.col("d") >= -60 * MINUTE) & (F.col("d") < 0), "pre").when((F.col("d") >= 0) & (F.col("d") <= 30 * MINUTE), "during").when((F.col("d") > 30 * MINUTE) & (F.col("d") <= 120 * MINUTE), "post")
    t = t.withColumn("slot", slot)
    mean = lambda s: F.avg(F.when(F.col("slot") == s, F.col(tone).cast("double")))
    p = t.groupBy("url").agg(mean("pre").alias("pre"), mean("during").alias("during"), mean("post").alias("post"), F.count("slot").alias("n"))
    shift = F.coalesce(F.col("post") - F.col("pre"), F.col("during") - F.col("pre"), F.col("during"))
    p = p.withColumn("shift", F.bround(shift, 4))
    return p.select("url", "n", *[F.bround(c, 4).alias(c) for c in ("pre", "during", "post")], "shift", F.coalesce(F.abs("shift") >= bar, F.lit(False)).alias("confirmed"))


def reply_intervals(comments: DataFrame, bots: DataFrame, within_s: int = 90, least: int = 2) -> DataFrame:
    """Comments of other actors that at least `least` bots follow on the same post within the time."""
    c = known(comments).filter(F.col("us").isNotNull()).select("url", "author", "us", "pos")
    marked = c.join(bots.select("author", F.lit(True).alias("bot")), "author", "left")
    p = range_self_join(marked.select("url", "author", "us", "pos", F.coalesce("bot", F.lit(False)).alias("bot")), "us", within_s * SECOND, ["url"], lambda a, b: ~a("bot") & b("bot") & (b("us") > a("us")))
    t = p.groupBy(F.col("a_url").alias("url"), F.col("a_author").alias("author"), F.col("a_us").alias("us")).agg(F.count_distinct("b_author").alias("bots"), F.min(F.col("b_us") - F.col("a_us")).alias("least_us"))
    return t.filter(F.col("bots") >= least)


def tag_adoption(uses: DataFrame, least_uses: int = 3, least_actors: int = 2) -> DataFrame:
    """uses (tag, author, us, pos): first hour's and peak hour's use of every tag, growth, first seeders, label."""
    t = uses.filter(F.col("us").isNotNull())
    base = t.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("author").alias("actors"), F.min("us").alias("first_us"))
    base = base.filter((F.col("uses") >= least_uses) & (F.col("actors") >= least_actors))
    curve = t.groupBy("tag", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    shape = curve.groupBy("tag").agg(F.min_by("n", "hour").alias("first_hour"), F.max("n").alias("peak_hour"), F.count(F.lit(1)).alias("hours"))
    seeds = t.withColumn("r", F.row_number().over(W.partitionBy("tag").orderBy("us", "pos"))).filter("r <= 3").groupBy("tag").agg(F.count_distinct("author").alias("seeders"))
    p = base.join(shape, "tag").join(seeds, "tag").withColumn("rate", F.bround(F.col("peak_hour") / F.greatest(F.col("first_hour"), F.lit(1)), 3))
    label = F.when(F.col("rate") >= 3, "RAPID_SEEDING").when(F.col("rate") >= 1.8, "AMPLIFIED").otherwise("ORGANIC")
    return p.select("tag", "uses", "actors", "first_hour", "peak_hour", "hours", "seeders", "rate", label.alias("tag_label"))


def sliding_windows(comments: DataFrame, width_min: int = 30, step_min: int = 15, since: bool = False) -> DataFrame:
    """Adds `window`: one row per comment and sliding window it lies in, windows counted from the first comment; and, if asked for, `since`: the first
    of a comment's windows."""
    t = comments.filter(F.col("us").isNotNull())
    start = t.agg(F.min("us").alias("start_us"))
    d = F.col("us") - F.col("start_us")
    hi = F.floor(d / (step_min * MINUTE))
    lo = F.greatest(F.lit(0), F.floor((d - width_min * MINUTE) / (step_min * MINUTE)) + 1)
    t = t.crossJoin(F.broadcast(start))
    return (t.withColumn("since", lo) if since else t).withColumn("window", F.explode(F.sequence(lo, hi))).drop("start_us")


def narrative_mutations(terms: DataFrame, bar: float = 0.65, least: int = 3, top: int = 50, voices: DataFrame | None = None) -> DataFrame:
    """terms (window, doc, term): weighs the `top` commonest terms by window, compares each window of at least `least`
    docs with the next by cosine, and types what fell to the bar or below. voices (window, caps: words in capitals,
    entities: array of names) tells INJECTION (a name that was not there) and AMPLIFICATION (half as many capitals
    again, and more terms lost than gained) from the rest."""
    d = terms.select("window", "doc", "term")
    sizes = stored(d.groupBy("window").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= least))
    vocab = d.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(top).select("term")
    d = d.join(sizes, "window").join(F.broadcast(vocab), "term")
    tf = stored(d.groupBy("window", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = sizes.agg(F.count(F.lit(1)).alias("windows"))
    # at most `top` rows a window, which norms and both sides of the dots read
    w = stored(tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log(F.col("windows") / (1 + F.col("df"))) + 1)))
    norm = w.groupBy("window").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count(F.lit(1)).alias("terms"))
    order = norm.withColumn("next", F.lead("window").over(W.orderBy("window"))).filter(F.col("next").isNotNull())  # one row per window
    a, b = w.select("window", "term", "w"), w.select(F.col("window").alias("next"), "term", F.col("w").alias("v"))
    dots = order.select("window", "next").join(a, "window").join(b, ["next", "term"]).groupBy("window").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    p = order.join(dots, "window", "left").join(norm.select(F.col("window").alias("next"), F.col("norm").alias("next_norm"), F.col("terms").alias("next_terms")), "next")
    p = p.withColumn("cosine", F.bround(F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("next_norm")), 4)).withColumn("shared", F.coalesce("shared", F.lit(0)))
    gone, new = F.col("terms") - F.col("shared"), F.col("next_terms") - F.col("shared")
    kind = F.when(F.col("cosine") > bar, "STABLE").when((F.col("shared") == 0) | (F.col("shared") / F.col("terms") < 0.2), "PIVOT")
    if voices is not None:
        voices = stored(voices)
        was, now = voices.select("window", F.col("caps").alias("was_caps"), F.col("entities").alias("was_names")), voices.select(F.col("window").alias("next"), "caps", "entities")
        p = p.join(was, "window", "left").join(now, "next", "left")
        none = F.array().cast("array<string>")
        injected = F.size(F.array_except(F.coalesce("entities", none), F.coalesce("was_names", none))) > 0
        louder = (F.coalesce("caps", F.lit(0)) > 1.5 * F.coalesce("was_caps", F.lit(0))) & (new < gone)
        kind = kind.when(injected, "INJECTION").when(louder, "AMPLIFICATION")
    kind = kind.when(new > 0.5 * gone, "EXPANSION").otherwise("CONVERGENCE")
    return p.select("window", "next", "terms", "next_terms", "shared", "cosine", kind.alias("mutation"))


def window_voices(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (window, text) -> (window, caps, entities): words of three capitals and more, and which of the `names` (lower case) its texts hold as words."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    caps = F.size(F.filter(runs, lambda w: w.rlike("^[A-ZÁÉÍÓÚÜÑ]{3,}$")))
    held = F.array_distinct(F.filter(F.transform(runs, F.lower), lambda w: w.isin(*names))) if names else F.array().cast("array<string>")
    r = rows.select("window", caps.alias("caps"), held.alias("held"))
    names_held = F.array_sort(F.array_distinct(F.flatten(F.collect_set("held"))))
    return r.groupBy("window").agg(F.sum("caps").alias("caps"), names_held.alias("entities"))


#: Points of a mutation by its kind (fixed values).
MUTATION_POINTS = {"PIVOT": 70, "INJECTION": 65, "EXPANSION": 45, "AMPLIFICATION": 40, "CONVERGENCE": 30}


def mutation_spread(mutations: DataFrame, terms: DataFrame, spread_min: int = 20) -> DataFrame:
    """mutations as `narrative_mutations` gives them, terms (window, author, us, term) -> those that aren't stable, with who first said one of the later
    window's new terms, how many others did so within the time, and points: by kind, up to 20 for the lost likeness, 2 for each who
    followed (10 at most). Terms of all windows count, not a window's ten commonest. since, if terms has it, is the first of the consecutive windows
    that a row lies in: what it says is not new where it lies in both."""
    m = stored(mutations.filter("mutation <> 'STABLE'"))
    pairs = m.select("window", "next")
    now = pairs.join(terms.withColumnRenamed("window", "next"), "next")
    if "since" in terms.columns:
        now = now.filter(F.col("since") > F.col("window"))
    was = terms.select("window", "term").distinct()
    # of new terms only who said one and when is kept: a row for each row of the window at most
    new = stored(now.join(was, ["window", "term"], "left_anti").select("window", "author", "us").distinct())
    first = new.groupBy("window").agg(F.min(F.struct("us", "author")).alias("first"))
    follow = new.join(first, "window").filter((F.col("us") > F.col("first.us")) & (F.col("us") <= F.col("first.us") + spread_min * MINUTE) & (F.col("author") != F.col("first.author")))
    adopted = follow.groupBy("window").agg(F.count_distinct("author").alias("adopted"))
    base = F.create_map(*[F.lit(x) for kv in MUTATION_POINTS.items() for x in kv])[F.col("mutation")]
    j = m.join(first, "window", "left").join(adopted, "window", "left").withColumn("adopted", F.coalesce("adopted", F.lit(0)))
    points = F.least(F.lit(100), base + F.floor(F.bround((1 - F.col("cosine")) * 20, 9)) + F.least(F.lit(10), 2 * F.col("adopted")))
    return j.select("window", "next", "mutation", "cosine", F.col("first.author").alias("introducer"), "adopted", points.cast("int").alias("points"))
