"""Continuous monitoring with Structured Streaming: watermarked windows and change alerts between cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def tumbling_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and actors by tumbling window; rows later than the watermark are dropped. Works on batches as well."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("actors"))


def sessions(stream: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of every actor that a gap ends."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def alert_of() -> tuple[Column, Column]:
    """Kind (null without alert) and severity from new_bots, new_terms, score, old_score, engagement and old_engagement of a cycle. A
    spike's severity goes before that of new actors."""
    bots, terms = F.col("new_bots") >= 3, F.col("new_terms") >= 4
    spike = (F.col("score") - F.col("old_score") >= 15) & (F.col("score") >= 40)
    surge = F.col("engagement") - F.col("old_engagement") >= 0.5 * F.greatest(F.col("old_engagement"), F.lit(1))
    kind = F.when(bots, "NEW_BOTS").when(spike, "CIB_SPIKE").when(terms, "NARRATIVE_PIVOT").when(surge, "ENGAGEMENT_SURGE")
    severity = F.when(spike, F.when(F.col("score") >= 80, "CRITICAL").otherwise("HIGH")).when(bots, F.when(F.col("new_bots") >= 10, "CRITICAL").otherwise("HIGH")).when(terms | surge, "MEDIUM").otherwise("INFO")
    return kind, severity


def alerts(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States (new_bots, score, new_terms, engagement) of two cycles, one row each (for each key of `by`): the alert's kind
    and severity.

    The first rule that fires names the alert; a spike sets the severity, later rules only raise INFO to MEDIUM.
    """
    by = by or []
    b, a = before.select(*by, F.col("score").alias("old_score"), F.col("engagement").alias("old_engagement")), after
    j = a.join(b, by) if by else a.crossJoin(b)  # one row each
    kind, severity = alert_of()
    return j.select(*by, kind.alias("alert"), severity.alias("severity"), "score", "new_bots", "new_terms").filter(F.col("alert").isNotNull())


def start_monitor(stream: DataFrame, cycle: Callable[[DataFrame], DataFrame], state_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes"):
    """Runs `cycle` (batch -> one state row) on every micro-batch, compares it with the state before and hands alerts to
    `sink`. State is a table by cycle number: a batch that is run again overwrites its own state."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        state = cycle(batch).withColumn("cycle", F.lit(number))
        state.write.mode("overwrite").parquet(f"{state_path}/cycle={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
        done = sorted(int(s.getPath().getName()[6:]) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().startswith("cycle="))
        earlier = [n for n in done if n < number]
        if earlier:
            sink(alerts(spark.read.parquet(f"{state_path}/cycle={earlier[-1]}"), spark.read.parquet(f"{state_path}/cycle={number}")), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
