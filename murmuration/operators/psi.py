"""Likelihood ratio of two behavioural models, one learned from organic actors and one from suspects: self-exciting
times and action sequences of order two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.operators.actors import known
from murmuration.operators.models import circadian
from murmuration.plans.checkpoints import stored

# Emoji that alone are a reaction, weights of the parts, the flat model of a machine, defaults without streams
REACTIONS = ["👍", "❤️", "😂", "😮", "😢", "😠"]
WEIGHT_TIMES, WEIGHT_ACTIONS, WEIGHT_RHYTHM = 0.4, 0.4, 0.2
FLAT_ALPHA, FLAT_BETA = 0.05, 1.0
MU, ALPHA, BETA = 0.1, 0.5, 0.3
LAPLACE = 0.1
#: Decay rates are kept between these; excitement is nothing to a double after NOTHING / beta seconds.
LEAST_BETA, MOST_BETA, NOTHING = 0.001, 50.0, 37.0


def action_of(text: Column) -> Column:
    """react, reply or comment."""
    t = F.trim(F.coalesce(text, F.lit("")))
    emoji = F.exists(F.array(*map(F.lit, REACTIONS)), lambda e: F.contains(t, e)) & (F.char_length(t) < 5)
    return F.when(F.char_length(t) < 2, "react").when(F.startswith(t, F.lit("↪")), "reply").when(emoji, "react").otherwise("comment")


def streams(comments: DataFrame, suspects: DataFrame, least_events: int = 2) -> DataFrame:
    """comments (author, us, pos, action) of known authors with a time -> author, us, pos, action, gap_s, and grp: 'bot' for those in
    suspects (author), else 'human'. Actors of fewer events have no group: they are scored, not learned from. Without suspects
    `with_fallback` gives the machine's model a teacher."""
    by = W.partitionBy("author")
    c = known(comments).filter(F.col("us").isNotNull()).select("author", "us", "pos", "action")
    c = c.withColumn("gap_s", (F.col("us") - F.lag("us").over(by.orderBy("us", "pos"))) / 1e6).withColumn("n", F.count(F.lit(1)).over(by))
    c = c.join(suspects.select("author", F.lit(True).alias("bot")).distinct(), "author", "left")
    return stored(c.withColumn("grp", F.when(F.col("n") >= least_events, F.when(F.col("bot"), "bot").otherwise("human"))).drop("bot"))


def with_fallback(s: DataFrame) -> DataFrame:
    """Streams in which somebody teaches the machine's model: without suspects the first organic actor by name does, and stays organic."""
    if s.filter("grp = 'bot'").isEmpty():
        first = s.filter("grp = 'human'").agg(F.min("author").alias("author"))
        return s.unionByName(s.join(F.broadcast(first), "author", "left_semi").withColumn("grp", F.lit("bot")))  # one row
    return s


def _runs(s: DataFrame, least_beta: float) -> DataFrame:
    """Streams in runs between gaps after which nothing is left of the excitement at any decay rate allowed: (author, grp, run, last, gaps).
    A stream without such gaps is one row."""
    by = W.partitionBy("author").orderBy("us", "pos")
    cut = F.coalesce((F.col("gap_s") > NOTHING / least_beta).cast("int"), F.lit(0))
    r = s.withColumn("run", F.sum(cut).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("cut", cut)
    g = r.groupBy("author", "grp", "run").agg(F.array_sort(F.collect_list(F.struct("us", "pos", F.when((F.col("cut") == 1) | F.col("gap_s").isNull(), -1.0).otherwise(F.col("gap_s")).alias("gap")))).alias("s"))
    last = g.groupBy("author").agg(F.max("run").alias("end"))
    g = g.join(last, "author").select("author", "grp", "run", (F.col("run") == F.col("end")).alias("last"), F.transform("s", lambda x: x["gap"]).alias("gaps"))
    return stored(g)


def _folded(runs: DataFrame, mu: Column, alpha: Column, beta: Column) -> DataFrame:
    """Per run: log (sum of log intensities), own (share of events that nothing excited), drawn (share that earlier ones did), delay (their mean
    distance, weighted), room (what the integral has for each unit of alpha)."""
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("a", "d", "log", "own", "drawn", "delay", "t")])

    def step(s: Column, gap: Column) -> Column:
        fade = F.when(gap < 0, 0.0).otherwise(F.exp(-beta * gap))
        a = fade * (1 + s["a"])
        # sum of distance * excitement: every earlier one is a gap farther away
        d = F.when(gap < 0, 0.0).otherwise(fade * s["d"] + gap * a)
        rate = F.greatest(mu + alpha * a, F.lit(1e-10))
        return F.struct(a.alias("a"), d.alias("d"), (s["log"] + F.log(rate)).alias("log"), (s["own"] + mu / rate).alias("own"), (s["drawn"] + alpha * a / rate).alias("drawn"), (s["delay"] + alpha * d / rate).alias("delay"), (s["t"] + F.greatest(gap, F.lit(0.0))).alias("t"))

    f = runs.withColumn("f", F.aggregate("gaps", zero, step))
    left = F.aggregate("gaps", F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("room")), lambda s, gap: F.struct((s["t"] + F.greatest(gap, F.lit(0.0))).alias("t"), (s["room"] + 1 - F.exp(-beta * (F.col("f.t") - s["t"] - F.greatest(gap, F.lit(0.0))))).alias("room")))["room"]
    room = F.when(F.col("last"), left).otherwise(F.size("gaps").cast("double")) / beta
    return f.select("author", "grp", "f.log", "f.own", "f.drawn", "f.delay", room.alias("room"))


def _spans(s: DataFrame) -> DataFrame:
    """(author, grp, n, span): at least a second, as in the numeric integral of a single event."""
    t = s.groupBy("author", "grp").agg(F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    return t.withColumn("span", F.when(F.col("span") > 0, F.col("span")).otherwise(1.0))


def fit_times(s: DataFrame, rounds: int = 15) -> dict[str, tuple[float, float, float]]:
    """(mu, alpha, beta) of 'human' and of 'bot' by expectation-maximisation over all streams of the group: a pass gives every event
    the probability that nothing, or an earlier event, brought it about; their sums are the next parameters. The machine's
    model stays flat: its excitement is fixed, only its rate is learned. Groups without streams keep the defaults."""
    learned = with_fallback(s).filter(F.col("grp").isNotNull())
    runs, spans = _runs(learned, LEAST_BETA), _spans(learned).groupBy("grp").agg(F.sum("span").alias("span"), F.sum("n").alias("n")).collect()
    held = {r.grp: (r.span, r.n) for r in spans}
    now = {"human": (MU, ALPHA, BETA), "bot": (MU, FLAT_ALPHA, FLAT_BETA)}
    for g, (span, n) in held.items():
        now[g] = (n / span, *((0.5 * BETA, BETA) if g == "human" else (FLAT_ALPHA, FLAT_BETA)))
    for _ in range(rounds if held else 0):
        pick = lambda k: F.when(F.col("grp") == "human", now["human"][k]).otherwise(now["bot"][k])  # noqa: B023, E731
        sums = _folded(runs, pick(0), pick(1), pick(2)).groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("own", "drawn", "delay", "room")]).collect()
        for r in sums:
            mu, alpha, beta = now[r.grp]
            mu = max(r.own / held[r.grp][0], 1e-9)
            if r.grp == "human" and r.room > 0:
                alpha = max(r.drawn / r.room, 0.0)
                # the share of children by parent stays alpha / beta while beta follows their mean distance
                if r.delay > 0:
                    new = min(MOST_BETA, max(LEAST_BETA, r.drawn / r.delay))
                    alpha, beta = alpha / beta * new, new
            now[r.grp] = (mu, alpha, beta)
    return now


def times_loglik(s: DataFrame, mu: float, alpha: float, beta: float) -> DataFrame:
    """(author, loglik): sum of the log intensities at the events less the integral of the intensity over the actor's span."""
    runs = _folded(_runs(s, beta), F.lit(mu), F.lit(alpha), F.lit(beta)).groupBy("author").agg(F.sum("log").alias("log"), F.sum("room").alias("room"))
    span = _spans(s).groupBy("author").agg(F.max("span").alias("span"))
    return runs.join(span, "author").select("author", (F.col("log") - mu * F.col("span") - alpha * F.col("room")).alias("loglik"))


def steps(s: DataFrame) -> DataFrame:
    """Every action with the two before it: (author, grp, b2, b1, action)."""
    by = W.partitionBy("author").orderBy("us", "pos")
    return s.select("author", "grp", F.lag("action", 2).over(by).alias("b2"), F.lag("action", 1).over(by).alias("b1"), "action").filter(F.col("b2").isNotNull())


def actions_loglik(s: DataFrame, group: str) -> DataFrame:
    """(author, loglik, entropy) of the actions under the group's counts with Laplace smoothing: the sum of log probabilities, and the mean of -log2.
    A state that the group never saw gives every action the same small share. Actors of fewer than three actions have no row."""
    t, taught = steps(s), with_fallback(s).filter(F.col("grp") == group)
    own = steps(taught)
    counts = own.groupBy("b2", "b1", "action").agg(F.count(F.lit(1)).alias("n"))
    states = own.groupBy("b2", "b1").agg(F.count(F.lit(1)).alias("total"))
    size = taught.agg(F.greatest(F.count_distinct("action"), F.lit(1)).alias("vocabulary"))
    j = t.groupBy("author", "b2", "b1", "action").agg(F.count(F.lit(1)).alias("k")).join(counts, ["b2", "b1", "action"], "left").join(states, ["b2", "b1"], "left").crossJoin(F.broadcast(size))  # one row
    v = F.col("vocabulary")
    p = F.when(F.col("total").isNull(), LAPLACE / (v + LAPLACE * v)).otherwise((F.coalesce("n", F.lit(0)) + LAPLACE) / (F.coalesce("total", F.lit(0)) + LAPLACE * v))
    return j.groupBy("author").agg(F.sum(F.col("k") * F.log(p)).alias("loglik"), (-F.sum(F.col("k") * F.log2(p)) / F.sum("k")).alias("entropy"))


def psi_scores(s: DataFrame, models: dict[str, tuple[float, float, float]] | None = None, least_actions: int = 3) -> DataFrame:
    """s as `streams` gives it -> per actor of at least so many actions: psi from -50 (organic) to 50, the two log-likelihoods, confidence,
    rhythm, entropy and diversity of the actions, band."""
    models = models or fit_times(s)
    n = s.groupBy("author").agg(F.count(F.lit(1)).alias("events"), (F.count_distinct("action") / F.count(F.lit(1))).alias("diversity")).filter(F.col("events") >= least_actions)
    j = n.join(circadian(s, 1).select("author", "circadian"), "author").withColumn("circadian", F.greatest(F.lit(0.0), F.col("circadian")))
    for g in ("human", "bot"):
        j = j.join(times_loglik(s, *models[g]).withColumnRenamed("loglik", f"times_{g}"), "author")
        j = j.join(actions_loglik(s, g).select("author", F.col("loglik").alias(f"actions_{g}"), F.col("entropy").alias(f"entropy_{g}")), "author", "left")
    size = s.filter("grp = 'human'").agg(F.count_distinct("action").alias("v"))
    j = j.crossJoin(F.broadcast(size)).fillna(0.0)  # one row
    side = lambda g, rhythm: F.col(f"times_{g}") * WEIGHT_TIMES + F.col(f"actions_{g}") * WEIGHT_ACTIONS + rhythm * WEIGHT_RHYTHM
    j = j.withColumn("ll_human", side("human", F.col("circadian"))).withColumn("ll_bot", side("bot", 1 - F.col("circadian"))).withColumn("raw", F.col("ll_bot") - F.col("ll_human"))
    top = F.when(F.col("v") > 0, F.greatest(F.log2(F.greatest("v", F.lit(1))), F.lit(1.0))).otherwise(5.0)
    psi = F.bround(F.col("raw") / F.greatest(F.abs("raw"), F.lit(10.0)) * 50, 1)
    band = F.when(F.col("psi") > 50, "HIGH_RISK").when(F.col("psi") < -50, "HUMAN").when(F.col("psi").between(-20, 20), "AMBIGUOUS").when(F.col("psi") > 20, "BOT_LIKE").otherwise("HUMAN_LIKE")
    return j.withColumn("psi", psi).select(
        "author", "events", "psi", F.bround("ll_bot", 2).alias("ll_bot"), F.bround("ll_human", 2).alias("ll_human"), F.bround(F.least(F.lit(1.0), F.abs("raw") / F.greatest(F.lit(10.0), F.abs("raw"))), 2).alias("confidence"),
        F.bround("circadian", 2).alias("circadian"), F.bround(F.least(F.lit(1.0), F.col("entropy_human") / top), 2).alias("entropy"), F.bround("diversity", 2).alias("diversity"), band.alias("band"),
    )


def psi_report(scores: DataFrame) -> DataFrame:
    """One row: actors, those by band, and their score from 0 to 100, weighted by events."""
    norm = (F.col("psi") + 100) / 2
    count = lambda b: F.count_if(F.col("band") == b)
    return scores.agg(F.count(F.lit(1)).alias("actors"), F.bround(F.coalesce(F.sum(norm * F.col("events")) / F.sum("events"), F.lit(0.0)), 1).alias("score"), count("HIGH_RISK").alias("high_risk"), count("AMBIGUOUS").alias("ambiguous"), count("HUMAN").alias("human"))
