"""State across campaigns and sessions: registry, fingerprints, session comparison, lexicons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys are not in table yet, one per key: what has to be appended."""
    return new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def appearances(comments: DataFrame, campaign, score=None) -> DataFrame:
    """(campaign, author, comments, posts, score) of every actor in every campaign; score is an aggregate, 0 by default."""
    return comments.withColumn("campaign", campaign).groupBy("campaign", "author").agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("url").alias("posts"), (F.lit(0) if score is None else score).alias("score"))


def registry_rollup(seen: DataFrame, least: int = 2) -> DataFrame:
    """Careers of actors over at least `least` campaigns: counts, sorted campaigns, mean score, class, persistence: up to
    50 points for campaigns, 30 for the score (0 to 100), 20 for comments."""
    a = seen.groupBy("author").agg(F.avg("score").alias("mean_score"), F.count_distinct("campaign").alias("campaigns"), F.sum("comments").alias("comments"), F.min("campaign").alias("first"), F.max("campaign").alias("last"), F.array_join(F.array_sort(F.collect_set(F.col("campaign").cast("string"))), ",").alias("campaign_list"))
    a = a.filter(F.col("campaigns") >= least)
    kind = F.when(F.col("campaigns") >= 5, "PROFESSIONAL").when(F.col("campaigns") >= 3, "PERSISTENT").otherwise("RECURRING")
    score = F.least(F.lit(50), 10 * F.col("campaigns")) + F.least(F.lit(30), F.floor(F.bround("mean_score", 4) * 3 / 10)) + F.least(F.lit(20), F.floor(F.col("comments") / 10))
    return a.withColumn("career", kind).withColumn("persistence", F.least(F.lit(100), score).cast("int")).withColumn("mean_score", F.bround("mean_score", 4))


def new_in_campaign(seen: DataFrame) -> DataFrame:
    """Per campaign: actors, and those that no other campaign has."""
    only = seen.groupBy("author").agg(F.count_distinct("campaign").alias("k"))
    return seen.join(only, "author").groupBy("campaign").agg(F.count(F.lit(1)).alias("actors"), F.count_if(F.col("k") == 1).alias("only_here"))


def session_delta(before: DataFrame, after: DataFrame, move: int = 15, high: int = 60) -> DataFrame:
    """before and after (author, score): full outer comparison with a status for every actor."""
    j = before.select("author", F.col("score").alias("was")).join(after.select("author", F.col("score").alias("now")), "author", "full")
    d = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    j = j.withColumn("delta", d)
    new, gone = F.col("was").isNull(), F.col("now").isNull()
    status = F.when(new & (F.col("now") >= high), "NEW_BOT").when(gone & (F.col("was") >= high), "DISAPPEARED").when(new | gone, "MINOR").when(F.col("delta") >= move, "SCORE_UP").when(F.col("delta") <= -move, "SCORE_DOWN").otherwise("STABLE")
    return j.withColumn("status", status)


def term_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after (term): one row with shared, gained and lost terms, Jaccard, label."""
    j = before.select("term", F.lit(1).alias("was")).join(after.select("term", F.lit(1).alias("now")), "term", "full")
    a = j.agg(F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull()).alias("shared"), F.count_if(F.col("was").isNull()).alias("gained"), F.count_if(F.col("now").isNull()).alias("lost"))
    jac = F.bround(F.col("shared") / F.greatest(F.col("shared") + F.col("gained") + F.col("lost"), F.lit(1)), 4)
    return a.withColumn("jaccard", jac).withColumn("drift", F.when(F.col("jaccard") >= 0.70, "STABLE").when(F.col("jaccard") >= 0.40, "SHIFT").otherwise("PIVOT"))


def identity_matches(current: DataFrame, historical: DataFrame, threshold: float = 0.75, block: int = 2048) -> DataFrame:
    """current and historical (author, fingerprint array<double>, bounded length): pairs of different names whose
    fingerprints' cosine reaches the threshold, with a level. Every two meet once, in pairs of blocks; a task holds two of them."""
    unit = lambda c: F.transform(c, lambda x: x / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12)))
    units = lambda df: df.filter(F.col("author").isNotNull()).dropDuplicates(["author"]).select("author", unit(F.col("fingerprint")).alias("u"))
    left, right = units(current), units(historical)
    n, m = (max(1, -(-df.count() // block)) for df in (left, right))
    mine = lambda k: F.pmod(F.xxhash64("author"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = left.select("author", "u", F.lit(True).alias("now"), mine(n).alias("i")).withColumn("j", every(m))
    right = right.select("author", "u", F.lit(False).alias("now"), mine(m).alias("j")).withColumn("i", every(n)).select("author", "u", "now", "i", "j")

    def run(t: pa.Table) -> pa.Table:
        def side(now: bool) -> tuple[pa.Array, np.ndarray]:
            rows = t.filter(pc.equal(t.column("now"), now))
            held = [[] if u is None else u for u in rows.column("u").to_pylist()]
            # what one of them lacks makes no cosine
            dense = np.full((len(held), max(map(len, held), default=0)), np.nan)
            for k, u in enumerate(held):
                dense[k, : len(u)] = u
            return rows.column("author").combine_chunks(), dense

        (a, u), (b, v) = side(True), side(False)
        out = []
        for k in range(0, len(u), 256):
            part = u[k : k + 256]
            cos = np.zeros((len(part), len(v)))
            if part.shape[1] != v.shape[1]:
                cos[:] = np.nan
            else:
                for d in range(v.shape[1]):
                    cos += np.multiply.outer(part[:, d], v[:, d])
            x, y = np.nonzero(cos >= threshold - 1e-4)  # Spark rounds and decides
            out.append(pa.table({"now": a.take(pa.array(x + k)), "was": b.take(pa.array(y)), "cosine": cos[x, y]}))
        return pa.concat_tables(out) if out else pa.table({"now": a[:0], "was": b[:0], "cosine": pa.array([], pa.float64())})

    names = [dict(df.dtypes)["author"] for df in (current, historical)]
    p = left.union(right).repartition(min(n * m, 2000), "i", "j").groupBy("i", "j").applyInArrow(run, f"now {names[0]}, was {names[1]}, cosine double")
    p = p.filter("now <> was").select("now", "was", F.bround("cosine", 4).alias("cosine")).filter(F.col("cosine") >= threshold)
    return p.withColumn("identity", F.when(F.col("cosine") >= 0.92, "CONFIRMED").when(F.col("cosine") >= 0.85, "PROBABLE").otherwise("POSSIBLE"))


def lexicon_upsert(lexicon: DataFrame, new: DataFrame, key: str = "word") -> DataFrame:
    """The lexicon with rows of new in place of those of equal key."""
    return lexicon.join(new.select(key), key, "left_anti").unionByName(new)


def lexicon_disable(lexicon: DataFrame, words: list[str], key: str = "word") -> DataFrame:
    return lexicon.withColumn("active", F.when(F.col(key).isin(*words), F.lit(False)).otherwise(F.col("active")))
