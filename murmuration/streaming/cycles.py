"""Monitoring cycles over an endless stream: known actors, terms and baselines are keyed state, not tables."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmuration.streaming.monitor import alert_of

#: Words that are no terms (fixed values, in order).
STOP = "de la el en que y los las por del a con es se un una para al su le lo más o pero https www com facebook fb".split()
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def terms(text: Column, stop: list[str] = STOP) -> Column:
    """Lower-case words of four letters and more, without marks around them."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]\"'@#/\\]+|[.,;:!?()\[\]\"'@#/\\]+$", ""))
    return F.filter(words, lambda w: (F.char_length(w) >= 4) & ~w.isin(*stop))


def facts(posts: DataFrame, every: str, late: str, suspicious: float = 60.0, shards: int = 64) -> DataFrame:
    """posts (campaign, ts, author, text, engagement, risk, score) -> (campaign, kind, shard, cycle, at, member, n, amount, score):
    by cycle the posts, the actors of a risk of `suspicious` and more, and the terms. Spark's own windowed aggregate, which adds up inside
    tasks before it shuffles and drops rows later than the watermark; rows without time or campaign take no part."""
    none = F.lit(None).cast("string")
    entry = lambda kind, member: F.struct(F.lit(kind).alias("kind"), member.alias("member"))
    bot = F.when((F.col("risk") >= suspicious) & F.col("author").isNotNull(), F.array(entry("bot", F.col("author"))))
    said = F.transform(terms(F.col("text")), lambda w: entry("term", w))
    every_kind = F.concat(F.array(entry("post", none)), F.coalesce(bot, F.array().cast("array<struct<kind:string,member:string>>")), said)
    p = posts.filter(F.col("ts").isNotNull() & F.col("campaign").isNotNull()).withWatermark("ts", late)
    p = p.select("campaign", "ts", F.coalesce("engagement", F.lit(0)).cast("double").alias("engagement"), F.coalesce("score", F.lit(0)).cast("double").alias("score"), F.explode(every_kind).alias("e"))
    g = p.groupBy(F.window("ts", every).alias("w"), "campaign", F.col("e.kind").alias("kind"), F.col("e.member").alias("member"))
    g = g.agg(F.count(F.lit(1)).alias("n"), F.sum("engagement").alias("amount"), F.max("score").alias("score"))
    shard = F.when(F.col("kind") == "post", F.lit(0)).otherwise(F.pmod(F.xxhash64("member"), F.lit(shards)).cast("int"))
    return g.select("campaign", "kind", shard.alias("shard"), F.unix_millis(F.col("w.end")).alias("cycle"), F.window_time("w").alias("at"), "member", "n", "amount", "score")


def _moment(cycle: int, timers) -> pd.Timestamp:
    """The time of a row that is handed on: no row may be older than the watermark."""
    return pd.Timestamp(max(cycle, timers.getCurrentWatermarkInMs()), unit="ms", tz="UTC")


PARTS = "campaign string, kind string, cycle bigint, at timestamp, fresh bigint, n bigint, amount double, score double, counts array<bigint>, words array<string>"


class Members(StatefulProcessor):
    """State by campaign, kind and shard of the members: the actors of the last cycle. Gives one row a cycle: actors that the cycle
    before didn't have, or the shard's commonest terms. A cycle's rows come in one batch, as the windows below close together."""

    def __init__(self, every_ms: int, top: int) -> None:
        self.every_ms, self.top = every_ms, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "member string")
        self.last = handle.getValueState("last", "cycle bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        campaign, kind, _ = key
        members, best = defaultdict(list), defaultdict(list)
        sums = defaultdict(lambda: [0, 0.0, 0.0])
        for t in rows:
            for cycle, part in t.groupby("cycle"):
                if kind == "bot":
                    members[cycle].extend(part["member"])
                elif kind == "term":
                    best[cycle] = heapq.nsmallest(self.top, [*best[cycle], *zip(-part["n"], part["member"])])
                s = sums[cycle]
                s[0], s[1], s[2] = s[0] + int(part["n"].sum()), s[1] + float(part["amount"].sum()), max(s[2], float(part["score"].max()))
        out = []
        for cycle in sorted(sums):
            fresh = 0
            if kind == "bot":
                before = self.last.get()
                known = {r[0] for r in self.known.get()} if before and before[0] == cycle - self.every_ms else set()
                fresh = len(set(members[cycle]) - known)
                self.known.put([(m,) for m in members[cycle]])
                self.last.update((int(cycle),))
            n, amount, score = sums[cycle]
            out.append((campaign, kind, int(cycle), _moment(int(cycle), timerValues), fresh, n, amount, score, [-int(c) for c, _ in best[cycle]], [w for _, w in best[cycle]]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    def close(self) -> None:
        pass


CYCLES = "campaign string, cycle timestamp, number bigint, posts bigint, score double, old_score double, engagement double, old_engagement double, new_bots bigint, new_terms bigint"


class Baseline(StatefulProcessor):
    """State by campaign: number, score, mean engagement and commonest terms of the last cycle. Gives a row for every cycle against the
    one before. A timer at the end of the next cycle finds that it was quiet: it counts as a cycle without posts,
    and the campaign then waits, without further timers, for its next post."""

    def __init__(self, every_ms: int, top: int) -> None:
        self.every_ms, self.top = every_ms, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "cycle bigint, number bigint, score double, engagement double, words array<string>, posts bigint")

    def _step(self, campaign: str, cycle: int, posts: int, score: float, amount: float, bots: int, words: list[str]) -> tuple:
        old = self.base.get()
        mean = amount / posts if posts else 0.0
        number, old_score, old_mean, old_words = (old[1], old[2], old[3], old[4]) if old else (0, 0.0, mean, [])
        self.base.update((cycle, number + 1, score, mean, words, posts))
        return campaign, pd.Timestamp(cycle, unit="ms", tz="UTC"), number + 1, posts, score, old_score, mean, old_mean, bots, len(set(words) - set(old_words))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in CYCLES.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, out = pd.concat(list(rows)), []  # some rows for each shard
        for cycle, part in t.groupby("cycle"):
            cycle, post, term = int(cycle), part[part["kind"] == "post"], part[part["kind"] == "term"]
            old = self.base.get()
            if old and old[0] < cycle - self.every_ms and old[5]:  # a quiet cycle, unless its timer has told of it
                out.append(self._step(key[0], old[0] + self.every_ms, 0, 0.0, 0.0, 0, []))
            best = heapq.nsmallest(self.top, [(-c, w) for cs, ws in zip(term["counts"], term["words"]) for c, w in zip(cs, ws)])
            bots = int(part.loc[part["kind"] == "bot", "fresh"].sum())
            out.append(self._step(key[0], cycle, int(post["n"].sum()), float(post["score"].max()), float(post["amount"].sum()), bots, [w for _, w in best]))
            self.handle.registerTimer(cycle + self.every_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, old = expiredTimerInfo.getExpiryTimeInMs(), self.base.get()
        if old and old[5] and old[0] + self.every_ms == at:
            yield self._frame([self._step(key[0], at, 0, 0.0, 0.0, 0, [])])

    def close(self) -> None:
        pass


def cycles(posts: DataFrame, every_s: int = 300, late: str = "1 minute", suspicious: float = 60.0, top: int = 10, shards: int = 64) -> DataFrame:
    """A stream of posts (campaign, ts, author, text, engagement, risk, score) -> a stream with a row for every campaign and cycle
    of `every_s` seconds, once the watermark has passed its end: its figures, those of the cycle before, alert and severity (null without one).

    Three steps, each keyed finer than the next: Spark's windowed counts by member; known members by shard of a campaign, so that one
    campaign spreads over `shards` tasks and a task holds a shard's members of a cycle; one small state by campaign.
    All state lies in the checkpoint, so a query that is started again goes on where it stopped; late rows are
    dropped. The first cycle has nothing before it: all its actors and terms are new. Equally common terms go by alphabet.
    A campaign without name, and posts without time, take no part; null texts have no terms, null numbers are 0.
    State needs the RocksDB store, which this sets for the session.
    """
    posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    f = facts(posts, f"{every_s} seconds", late, suspicious, shards)
    parts = f.groupBy("campaign", "kind", "shard").transformWithStateInPandas(Members(every_s * 1000, top), PARTS, "Append", "EventTime", eventTimeColumnName="at")
    c = parts.groupBy("campaign").transformWithStateInPandas(Baseline(every_s * 1000, top), CYCLES, "Append", "EventTime")
    alert, severity = alert_of()
    return c.withColumn("alert", alert).withColumn("severity", F.when(alert.isNotNull(), severity))
