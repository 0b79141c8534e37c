"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are aggregated by encoded length; from then on work and rows depend on the number of
different lengths alone. Suffix sums over the lengths answer, for any limit L: documents and tokens
at or above L, total tokens after truncation to L, and the share of documents below a length, from
which quantiles are read. Sums run inside runs of SPAN lengths; only the runs' totals are summed in
one task, and their number is at most the longest document's length / SPAN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.llm import bpe, scratch

SPAN = 512


def length_table(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Per distinct length: n_tokens, n_docs, docs_ge, tokens_ge (suffix sums), docs_le (prefix sum),
    docs_total, tokens_total, truncated_total (tokens left when every document is cut to this length).

    Null lengths count as 0. Equal rows count as many times as they occur; an empty table gives no rows.
    Only the named column is read, so columns of other names, whatever they are, don't matter; lengths of any size count.
    """
    n = F.coalesce(F.col(column).cast("long"), F.lit(0))
    hist = scratch.materialize(lengths.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    hist = hist.withColumn("run", F.floor(F.col("n_tokens") / SPAN))
    runs = hist.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later, every = W.orderBy("run").rowsBetween(1, W.unboundedFollowing), W.partitionBy()
    runs = runs.select("run", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = W.partitionBy("run").orderBy("n_tokens").rowsBetween(0, W.unboundedFollowing)
    out = hist.join(runs, "run")
    out = out.withColumn("docs_ge", F.sum("n_docs").over(inside) + F.col("d_after"))
    out = out.withColumn("tokens_ge", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_after"))
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge", (F.col("docs_total") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"), "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, tokens (total after truncation), for limits that need not be lengths in the table."""
    spark = table.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "`limit` bigint"))
    over = F.col("n_tokens") > F.col("limit")
    # each length meets the stated limits only: a bounded list that the caller gives
    t = table.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("limit"))
    sums = t.groupBy("limit").agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("tokens"))
    return asked.distinct().join(sums, "limit", "left").select("limit", F.coalesce("docs_over", F.lit(0)).alias("docs_over"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents does not exceed."""
    t = table.select("n_tokens", "docs_le", "docs_total", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return t.filter(F.col("docs_le") >= F.col("share") * F.col("docs_total")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, counts=True)
    return length_table(coded.select("n_tokens"))
