"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the corpus size is shared by weight, no source may exceed `max_epochs`
passes over itself, and what a capped source cannot take is shared again by weight. All capped
sources lie below one water level, so one sort of the sources by `cap / weight` finds it: no loop.

Inside a source, `floor(epochs)` whole repetitions of every document are taken; the fraction is a
prefix of the source in the order of a seeded digest of doc_id. The prefix is found from sums of
digest buckets, and rows are ordered only inside the one bucket where it ends, so a source that
holds a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from murmuration.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that make a bucket: 4096 buckets in a source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    """Words of a text; null: 0. Counted as starts, so no array of words is built."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", "")).cast("long")


def weights_by_rank(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Adds `weight`: the given ones in turn over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: float = 3) -> DataFrame:
    """sources (source, source_size, weight): adds target = min(max_epochs * size, level * weight).

    The targets add up to the sum of sizes (always feasible for max_epochs >= 1). A source of size 0
    or weight 0 gets 0. The table has one row per source, so its windows are over the sources alone.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    t = sources.withColumn("cap", cap).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    by = W.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(before), F.lit(0.0)))
    t = t.withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source, by ratio, that its share doesn't fill sets the level for all from there on
    level = F.when((F.col("weight") > 0) & (F.col("left") <= F.col("ratio") * F.col("heavy")), F.col("left") / F.col("heavy"))
    t = t.withColumn("level", F.max(level).over(every)).withColumn("first", F.min(F.when(level.isNotNull(), F.col("ratio"))).over(every))
    free = F.col("first").isNotNull() & (F.col("ratio") >= F.col("first"))
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(free, F.least(F.col("cap"), F.col("weight") * F.col("level"))).otherwise(F.col("cap"))
    return t.withColumn("target", target).select(*sources.columns, "target")


@scratch.sized
def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: str = "mix-1") -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, repeats, taken.

    Nulls: a null text has size 0; null is a source of its own, last by rank; a null doc_id is hashed
    as an empty string. Equal rows are told apart by nothing: they fall on one side of the cut or the
    cut lies between them. A document without words is taken as often as its neighbours in the digest's order,
    never more than max_epochs times. Texts of any length are counted whole. Empty input gives no rows. Other
    columns are ignored.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("digest"))
    # the texts are read once; what follows is about their sizes
    sized = scratch.materialize(sized.withColumn("bucket", F.conv(F.substring("digest", 1, BUCKET_DIGITS), 16, 10).cast("int")), "sizes")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = water_fill(weights_by_rank(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(epochs)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    s = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "need")
    starts = sums.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    by = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("bucket_size").over(by), F.lit(0)))
    starts = starts.withColumn("side", F.when((F.col("need") <= 0) | (F.col("before") > F.col("need")), 0).when(F.col("before") + F.col("bucket_size") <= F.col("need"), 1))
    t = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole", "need", "before", "side")
    placed = sized.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inner = W.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = placed.filter(F.col("side").isNull())
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    cut = cut.withColumn("side", F.when((F.col("need") > 0) & (ahead + F.col("size") / 2 <= F.col("need")), 1).otherwise(0))
    both = placed.filter(F.col("side").isNotNull()).unionByName(cut)
    repeats = (F.col("whole") + F.col("side")).cast("int")
    return both.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).cast("long").alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                  source_size * 3.0::DOUBLE AS cap FROM sums),
run AS (SELECT *, cap / weight AS ratio,
          sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
          sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM ranked),
lev AS (SELECT *, max(CASE WHEN lft <= ratio * heavy THEN lft / heavy END) OVER () AS level,
               min(CASE WHEN lft <= ratio * heavy THEN ratio END) OVER () AS first_ratio FROM run),
tgt AS (SELECT source, source_size, CASE WHEN ratio >= first_ratio THEN least(cap, weight * level) ELSE cap END AS target FROM lev),
need AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM tgt),
placed AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN ahead + size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
