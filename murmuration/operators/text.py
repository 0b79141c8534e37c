"""Operators on texts: near copies, term weights, clusters, narratives, sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.functions.text import normal, tokens, word_shingles
from murmuration.plans.joins import similar_sets
from murmuration.plans.kernels import leader_clusters


def near_copies(rows: DataFrame, key: str = "url", text: str = "text", threshold: float = 0.65, n: int = 3) -> DataFrame:
    """Pairs of rows whose word n-gram sets reach the Jaccard threshold: exact, by prefix filtering."""
    s = rows.select(key, word_shingles(normal(F.col(text)), n).alias("t"))
    return similar_sets(s, key, "t", threshold).withColumn("jaccard", F.bround("jaccard", 4))


def near_copy_comments(comments: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Near copies by different actors on different posts."""
    c = comments.withColumn("id", F.concat_ws("/", "url", F.col("pos").cast("string")))
    p = near_copies(c, "id", "text", threshold)
    who = c.select("id", "author", "url")
    p = p.join(who.select(F.col("id").alias("a"), F.col("author").alias("aa"), F.col("url").alias("ua")), "a").join(who.select(F.col("id").alias("b"), F.col("author").alias("ab"), F.col("url").alias("ub")), "b")
    return p.filter((F.col("aa") != F.col("ab")) & (F.col("ua") != F.col("ub"))).select("a", "b", "shared", "jaccard")


def bigram_jaccard(rows: DataFrame, key: str = "url", text: str = "text", threshold: float = 0.5) -> DataFrame:
    return near_copies(rows, key, text, threshold, 2)


def term_counts(rows: DataFrame, key: str, text: str = "text", least_letters: int = 3) -> DataFrame:
    """(key, term, tf) of lower-case words with at least so many letters."""
    t = rows.select(key, F.explode(tokens(F.col(text), least_letters)).alias("term"))
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(rows: DataFrame, k: int = 30, text: str = "text", least_letters: int = 4) -> DataFrame:
    t = rows.select(F.explode(tokens(F.col(text), least_letters)).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def tfidf(rows: DataFrame, key: str, text: str = "text", variant: str = "relative") -> DataFrame:
    """(key, term, weight) in one of three weightings: `relative` tf/len * (ln(n/df) + 1); `smooth` tf * (ln((n+1)/(df+1)) + 1)
    scaled to length 1; `dampened` tf * (ln(n/(1+df)) + 1) scaled to length 1."""
    tf = term_counts(rows, key, text)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = rows.agg(F.count_distinct(key).alias("n"))
    t = tf.join(df, "term").crossJoin(F.broadcast(n))
    if variant == "relative":
        size = tf.groupBy(key).agg(F.sum("tf").alias("len"))
        return t.join(size, key).select(key, "term", F.bround(F.col("tf") / F.col("len") * (F.log(F.col("n") / F.col("df")) + 1), 6).alias("weight"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1 if variant == "smooth" else F.log(F.col("n") / (1 + F.col("df"))) + 1
    t = t.withColumn("w", F.col("tf") * idf)
    norm = t.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return t.join(norm, key).select(key, "term", F.bround(F.col("w") / F.greatest(F.col("norm"), F.lit(1e-12)), 6).alias("weight"))


def text_clusters(rows: DataFrame, key: str, threshold: float, variant: str = "smooth", running: bool = False, most: int | None = None) -> DataFrame:
    """Leader clusters of weighted texts; sequential by key, over all rows unless `most` limits them."""
    v = tfidf(rows, key, variant=variant).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    return leader_clusters(v, key, "terms", threshold, running, most)


def injected_narratives(rows: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Clusters of two and more rows (with url) as narratives: size, reach, score."""
    c = rows.join(clusters, key).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("url").alias("posts"), F.count_distinct("author").alias("actors"))
    score = F.least(F.lit(50.0), 50 * F.log(F.col("size") + 1)) + F.least(F.lit(50.0), 8.0 * F.col("posts"))
    return c.filter("size >= 2").withColumn("score", score.cast("int"))


def cluster_dominance(rows: DataFrame, clusters: DataFrame, bots: DataFrame, key: str, bar: float = 0.5) -> DataFrame:
    """Share of suspicious actors in every cluster."""
    r = rows.join(clusters, key).join(bots.select("author", F.lit(1).alias("bot")), "author", "left")
    c = r.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.bround(F.avg(F.coalesce("bot", F.lit(0))), 4).alias("bot_share"))
    return c.withColumn("dominated", F.col("bot_share") >= bar)


def seeded_texts(rows: DataFrame, components: DataFrame, key: str, least_posts: int = 2) -> DataFrame:
    """Groups of like texts (key -> component) that stand on at least so many posts."""
    g = rows.join(components.select(F.col("node").alias(key), "component"), key).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("url").alias("posts"), F.count_distinct("author").alias("actors"))
    return g.filter(F.col("posts") >= least_posts)


def sentiment(rows: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text", negators: list[str] | None = None, boosters: list[str] | None = None) -> DataFrame:
    """lexicon (word, polarity, score) -> per row: negative, positive, net and label.

    A word counts 0.55 of its score behind a negator among the four words before, else 1.45 behind a booster
    among the two before; sums are divided by 12 and capped at 1.
    """
    words = tokens(F.col(text), 1)
    w = rows.select(*key, words.alias("ws")).select(*key, "ws", F.posexplode("ws").alias("i", "word")).join(F.broadcast(lexicon), "word")
    back = lambda n: F.slice("ws", F.greatest(F.lit(1), F.col("i") - (n - 1)), F.least(F.col("i"), F.lit(n)))
    hit = lambda n, xs: F.arrays_overlap(back(n), F.array(*map(F.lit, xs))) if xs else F.lit(False)
    value = F.col("score") * F.when(hit(4, negators), 0.55).when(hit(2, boosters), 1.45).otherwise(1.0)
    side = lambda p: F.bround(F.least(F.lit(1.0), F.sum(F.when(F.col("polarity") == p, value).otherwise(0.0)) / 12), 3)
    s = w.groupBy(*key).agg(side("negative").alias("negative"), side("positive").alias("positive"))
    s = rows.select(*key).distinct().join(s, key, "left").fillna(0.0, ["negative", "positive"])
    label = F.when((F.col("negative") >= 0.15) & (F.col("negative") >= F.col("positive")), "NEGATIVE").when(F.col("positive") >= 0.15, "POSITIVE").otherwise("NEUTRAL")
    return s.withColumn("net", F.bround(F.col("positive") - F.col("negative"), 3)).withColumn("label", label)


def vector_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = 2048) -> DataFrame:
    """(a, b, cosine) of vectors a < b at or above the threshold: exact, in pairs of blocks, so that each task holds
    two bounded blocks and Catalyst never sees a cross join."""
    unit = F.transform(F.col(vector), lambda x: x.cast("double"))
    v = vectors.select(F.col(key).alias("k"), unit.alias("v")).filter(F.col("v").isNotNull())
    n = max(1, -(-v.count() // block))
    v = v.withColumn("mine", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = v.select("k", "v", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(t):
        import numpy as np
        import pandas as pd

        m = np.array(t["v"].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        k, mine, i, j = t["k"].to_numpy(), t["mine"].to_numpy(), t["i"].iloc[0], t["j"].iloc[0]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        s = m[left] @ m[right].T
        x, y = np.nonzero(s >= threshold)
        a, b, c = k[left[x]], k[right[y]], s[x, y]
        keep = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": np.round(c[keep], 4)})

    kind = vectors.schema[key].dataType.simpleString()
    return v.groupBy("i", "j").applyInPandas(run, f"a {kind}, b {kind}, cosine double")


def attack_predicate(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)) if words else F.lit(False)


def narrative_key(rows: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k commonest words (four letters or more) of every key, in alphabetical order."""
    t = term_counts(rows, key, least_letters=4)
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc("tf"), "term"))
    return t.withColumn("r", r).filter(F.col("r") <= k).groupBy(key).agg(F.array_sort(F.collect_list("term")).alias("narrative"))


def centroid_terms(weights: DataFrame, clusters: DataFrame, key: str, most: int = 8) -> DataFrame:
    """weights (key, term, weight), clusters (key, cluster) -> the `most` terms of highest mean weight of every cluster; a row without the
    term counts as 0, equal means go by alphabet."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    m = weights.join(clusters.select(key, "cluster"), key).groupBy("cluster", "term").agg(F.sum("weight").alias("sum")).join(sizes, "cluster")
    m = m.select("cluster", "term", F.bround(F.col("sum") / F.col("size"), 6).alias("mean"))
    r = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("mean"), "term"))
    return m.withColumn("r", r).filter(F.col("r") <= most).drop("r")
