"""Behavioural models of single streams: self-exciting times, action sequences, day rhythm, stylometry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.operators.actors import known
from murmuration.plans import products


def _gaps(comments: DataFrame) -> DataFrame:
    by = W.partitionBy("author").orderBy("us", "pos")
    return known(comments).filter(F.col("us").isNotNull()).select("author", "us", "pos", "action", ((F.col("us") - F.lag("us").over(by)) / 1e6).alias("gap_s"))


def hawkes_fit(comments: DataFrame, least: int = 3) -> DataFrame:
    """Per actor: base rate n / span, and self-excitement from the burstiness of the gaps, clamped to [0, 0.9]."""
    g = _gaps(comments).groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("gap_s").alias("span_s"), F.avg("gap_s").alias("mean_gap"), F.var_pop("gap_s").alias("var_gap"))
    g = g.filter((F.col("n") >= least) & (F.col("span_s") > 0))
    burst = (F.col("var_gap") - F.col("mean_gap")) / (F.col("var_gap") + F.col("mean_gap"))
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(0.9), (burst + 1) / 2))
    return g.select("author", "n", "span_s", (F.col("n") / F.col("span_s")).alias("mu"), alpha.alias("alpha"))


def hawkes_loglik(comments: DataFrame, mu: float | None = None, alpha: float | None = None, beta: float = 1.0, least: int = 3) -> DataFrame:
    """Log-likelihood of every actor's times under an exponential self-exciting process, with own or given parameters.

    The excitement obeys A_i = exp(-beta * gap) * (1 + A_(i-1)), so one fold over the sorted gaps is exact.
    """
    fit = hawkes_fit(comments, least)
    g = _gaps(comments).filter(F.col("gap_s").isNotNull())
    seq = g.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("us", "pos", "gap_s"))).alias("s"))
    t = fit.join(seq, "author")
    m = F.lit(mu) if mu is not None else F.col("mu")
    a = F.lit(alpha) if alpha is not None else F.col("alpha")
    zero = F.struct(F.lit(0.0).alias("A"), F.log(m).alias("ll"), F.lit(0.0).alias("t"))

    def step(acc: Column, x: Column) -> Column:
        excite = F.exp(-beta * x["gap_s"]) * (1 + acc["A"])
        return F.struct(excite.alias("A"), (acc["ll"] + F.log(m + a * excite)).alias("ll"), (acc["t"] + x["gap_s"]).alias("t"))

    folded = F.aggregate("s", zero, step)
    # the integral of the intensity needs the time from each event to the end
    after = F.aggregate("s", F.struct(F.lit(0.0).alias("t"), (1 - F.exp(-beta * F.col("span_s"))).alias("c")), lambda acc, x: F.struct((acc["t"] + x["gap_s"]).alias("t"), (acc["c"] + 1 - F.exp(-beta * (F.col("span_s") - acc["t"] - x["gap_s"]))).alias("c")))
    t = t.withColumn("f", folded).withColumn("c", after["c"])
    return t.select("author", "n", F.bround(F.col("f.ll") - m * F.col("span_s") - a / beta * F.col("c"), 3).alias("loglik"))


def circadian(comments: DataFrame, least: int = 3) -> DataFrame:
    """Share of night hours (22 to 8) and 1 - 2 |share - 1/3|: near 1 for a day as people keep it."""
    hour = F.pmod(F.floor(F.col("us") / 3_600_000_000), F.lit(24))
    t = known(comments).filter(F.col("us").isNotNull()).withColumn("night", ((hour >= 22) | (hour < 8)).cast("int"))
    c = t.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.avg("night").alias("share")).filter(F.col("n") >= least)
    return c.select("author", "n", F.bround("share", 4).alias("night_share"), F.bround(1 - 2 * F.abs(F.col("share") - 1 / 3), 4).alias("circadian"))


def markov_transitions(comments: DataFrame) -> DataFrame:
    """Counts of actions after the two before: (before2, before1, action, n) over all actors."""
    by = W.partitionBy("author").orderBy("us", "pos")
    t = known(comments).select(F.lag("action", 2).over(by).alias("before2"), F.lag("action", 1).over(by).alias("before1"), "action")
    return t.filter(F.col("before2").isNotNull()).groupBy("before2", "before1", "action").agg(F.count(F.lit(1)).alias("n"))


def action_loglik(comments: DataFrame, transitions: DataFrame, vocabulary: int, laplace: float = 0.1) -> DataFrame:
    """Mean log-probability of every actor's actions under the pooled transitions."""
    by = W.partitionBy("author").orderBy("us", "pos")
    t = known(comments).select("author", F.lag("action", 2).over(by).alias("before2"), F.lag("action", 1).over(by).alias("before1"), "action").filter(F.col("before2").isNotNull())
    total = transitions.groupBy("before2", "before1").agg(F.sum("n").alias("all"))
    t = t.join(transitions, ["before2", "before1", "action"], "left").join(total, ["before2", "before1"], "left")
    p = (F.coalesce("n", F.lit(0)) + laplace) / (F.coalesce("all", F.lit(0)) + laplace * vocabulary)
    return t.groupBy("author").agg(F.count(F.lit(1)).alias("steps"), F.bround(F.avg(F.log(p)), 4).alias("mean_loglik"))


def action_diversity(comments: DataFrame) -> DataFrame:
    """Entropy (bits) of every actor's actions and the share of different ones."""
    c = known(comments).groupBy("author", "action").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("author"))
    return c.withColumn("p", p).groupBy("author").agg(F.sum("n").alias("n"), F.bround(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"), F.count(F.lit(1)).alias("kinds"))


def psi(comments: DataFrame, bot_alpha: float = 0.05, beta: float = 1.0, least: int = 3) -> DataFrame:
    """Log-likelihood ratio between a machine-like and an own, human-like model of each actor's stream, scaled to
    [-50, 50], with bands. 0.4 times + 0.4 actions + 0.2 rhythm; the times are compared per event."""
    human = hawkes_loglik(comments, beta=beta, least=least).select("author", "n", F.col("loglik").alias("h"))
    fit = hawkes_fit(comments, least).select("author", "mu")
    machine = hawkes_loglik(comments, alpha=bot_alpha, beta=beta, least=least).select("author", F.col("loglik").alias("b"))
    tr = markov_transitions(comments)
    act = action_loglik(comments, tr, 5).select("author", "mean_loglik")
    rhythm = circadian(comments, least).select("author", "circadian")
    t = human.join(machine, "author").join(fit, "author").join(act, "author", "left").join(rhythm, "author", "left")
    raw = 0.4 * (F.col("b") - F.col("h")) / F.col("n") + 0.4 * (F.coalesce("mean_loglik", F.lit(-math.log(5.0))) + math.log(5.0)) + 0.2 * (1 - 2 * F.coalesce("circadian", F.lit(0.5)))
    value = F.bround(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), raw * 50 / F.greatest(F.abs(raw), F.lit(10.0)))), 3)
    t = t.withColumn("psi", value)
    band = F.when(F.col("psi") >= 50, "HIGH_RISK").when(F.col("psi") >= 20, "ELEVATED").when(F.col("psi") <= -50, "HUMAN").when(F.col("psi") <= -20, "LIKELY_HUMAN").otherwise("ABSTAIN")
    return t.select("author", "n", "psi", band.alias("band"))


def character_grams(rows: DataFrame, key: str, text: str = "text", n: int = 3, top: int = 30) -> DataFrame:
    """The `top` commonest character n-grams of every key: (key, gram, n, share)."""
    grams = F.regexp_extract_all(F.lower(text), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    g = rows.filter(F.length(text) >= n).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(key)
    g = g.withColumn("share", F.bround(F.col("n") / F.sum("n").over(by), 6)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "gram")))
    return g.filter(F.col("r") <= top).drop("r")


def style_delta(frequencies: DataFrame, key: str, token: str = "token", share: str = "share") -> DataFrame:
    """Root mean square difference of token shares over the union of tokens, for pairs of keys that share a token."""
    f = frequencies.select(F.col(key).alias("k"), F.col(token).alias("t"), F.col(share).alias("s"))
    size = f.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("sq"))
    both = f.select(F.col("k").alias("a"), "t", F.col("s").alias("sa")).join(f.select(F.col("k").alias("b"), "t", F.col("s").alias("sb")), "t").filter("a < b")
    p = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    p = p.join(size.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("sq").alias("qa")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("sq").alias("qb")), "b")
    delta = F.sqrt(F.greatest(F.lit(0.0), F.col("qa") + F.col("qb") - 2 * F.col("dot")) / (F.col("na") + F.col("nb") - F.col("shared")))
    return p.select("a", "b", "shared", F.bround(delta, 6).alias("delta"))


def style_and_hours(counts: DataFrame, comments: DataFrame) -> DataFrame:
    """`style_delta` of counts (author, token, n) as shares of their author's, joined with `hour_occupancy`: (a, b, shared, delta, anticorrelation).
    A pair is made once, in a product of blocks that holds its tokens and hours."""
    token = F.coalesce(F.col("token").cast("string"), F.concat(F.lit("\0"), "author"))  # an unknown token is nobody else's
    mask = _hours(comments).select("author", F.aggregate("hours", F.lit(0), lambda x, h: x + F.call_function("shiftleft", F.lit(1), h)).cast("string").alias("mask"))
    of = counts.join(mask, "author").select(F.lit("").alias("part"), F.col("author").alias("node"), F.col("mask").alias("tag"), token.alias("group"), "n")
    inc = products.incidence(products.group_numbers(of))

    def run(part, a: products.Side, b: products.Side, m: np.ndarray):
        (ta, qa), (tb, qb) = ([np.bincount(s.row, s.ns**k, len(s)) for k in (1, 2)] for s in (a, b))
        shared = np.zeros(m.shape, np.float32)
        for groups in products.shared_groups(a, b):
            shared += (a.matrix(groups, np.float32) > 0).astype(np.float32) @ (b.matrix(groups, np.float32) > 0).astype(np.float32).T
        ha, hb = (np.array(s.tags.to_pylist()).astype(np.int64) for s in (a, b))
        wa, wb = qa / ta**2, qb / tb**2
        # m of a block with itself is above the diagonal only, shared is not
        i, j = np.nonzero((m > 0) & (ha[:, None] & hb != 0))
        k, both = shared[i, j].astype(np.int64), np.bitwise_count(ha[i] & hb[j]).astype(np.int64)
        either = np.bitwise_count(ha[i] | hb[j]).astype(np.int64)
        square = np.maximum(0.0, wa[i] + wb[j] - 2 * (m[i, j].astype(float) / (ta[i] * tb[j])))
        yield products.named(["a", "b", "shared", "delta", "both", "either"], products.taken(a.names, i), products.taken(b.names, j), k, np.sqrt(square / (a.sizes[i] + b.sizes[j] - k)), both, either)

    p = products.block_products(inc, run, "a string, b string, shared bigint, delta double, both bigint, either bigint")
    return p.select("a", "b", "shared", F.bround("delta", 6).alias("delta"), F.bround((F.col("either") - F.col("both")) / F.col("either"), 4).alias("anticorrelation"))


def _hours(comments: DataFrame) -> DataFrame:
    hour = F.pmod(F.floor(F.col("us") / 3_600_000_000), F.lit(24)).cast("int")
    return known(comments).filter(F.col("us").isNotNull()).groupBy("author").agg(F.array_sort(F.collect_set(hour)).alias("hours"))


def hour_occupancy(comments: DataFrame) -> DataFrame:
    """Pairs of actors: share of the hours of the day in which just one of them is ever active. A pair is made once, however many hours it shares."""
    of = _hours(comments).select(F.lit("").alias("part"), F.col("author").alias("node"), F.lit(None).cast("string").alias("tag"), F.explode("hours").alias("group"), F.lit(1).alias("n"))
    p = products.block_products(products.incidence(of), products.overlaps, "a string, b string, both bigint, either bigint")
    return p.select("a", "b", "both", F.bround((F.col("either") - F.col("both")) / F.col("either"), 4).alias("anticorrelation"))


def sockpuppets(delta: DataFrame, occupancy: DataFrame, bar: float = 0.65) -> DataFrame:
    """Confidence that two accounts have one operator: like style and hours that avoid each other. Both may be one frame, as `style_and_hours` gives it."""
    p = delta if delta is occupancy else delta.join(occupancy.select("a", "b", "anticorrelation"), ["a", "b"])
    shared = F.least(F.col("shared") / 30, F.lit(1.0))
    conf = F.bround(0.4 * (1 - F.least(F.col("delta"), F.lit(1.0))) + 0.4 * F.col("anticorrelation") + 0.2 * shared, 4)
    return p.select("a", "b", conf.alias("confidence"), (conf > bar).alias("same_operator"))
