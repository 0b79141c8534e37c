"""Sequential kernels, each behind a bounded group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.plans.checkpoints import stored


#: Rows of a slice of the stream that a task scans.
SLICE = 200_000


def _sliced(events: DataFrame, rows_a_slice: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """events in slices of consecutive rows by (us, pos), numbered inside; and by slice its rows and its last time. A
    slice has about `rows_a_slice` rows; the driver holds two numbers a slice."""
    rows = events.filter(F.col("us").isNotNull()).select("author", "us", "pos")
    n = rows.count()
    cut = rows.repartitionByRange(max(1, -(-n // rows_a_slice)), "us", "pos").sortWithinPartitions("us", "pos", "author")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], ["author", "us", "pos", "slice", "place"])
            at += batch.num_rows

    placed = stored(cut.withColumn("slice", F.spark_partition_id().cast("long")).mapInArrow(number, "author string, us bigint, pos bigint, slice bigint, place bigint"))
    held = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last")).orderBy("slice").collect()
    # slices without rows leave no gap in the numbers
    names = {r.slice: k for k, r in enumerate(held)}
    if list(names) != list(range(len(names))):
        number_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        placed = placed.withColumn("slice", number_of[F.col("slice")].cast("long"))
    return placed, np.array([r.n for r in held], np.int64), np.array([r.last for r in held], np.int64)


def _scan(t: pd.DataFrame, own: int, width: int, least: int, least_authors: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of the window that each of the first `own` rows begins, whether it is taken)."""
    us, author = t["us"].to_numpy(), t["author"].to_numpy()
    ends = np.searchsorted(us, us[:own] + width, "right")
    taken = ends - np.arange(own) >= least
    if least_authors > 1 and taken.any():
        inside: dict = {}
        last = 0
        for i in range(own):
            for a in author[last : ends[i]]:
                inside[a] = inside.get(a, 0) + 1
            last = int(ends[i])
            taken[i] &= len(inside) >= least_authors
            left = inside[author[i]] - 1
            if left:
                inside[author[i]] = left
            else:
                del inside[author[i]]
    return ends, taken


def greedy_windows(events: DataFrame, width: int, least: int, least_authors: int = 2, merge_gap: int | None = None, rows_a_slice: int = SLICE) -> DataFrame:
    """Windows (start_us, end_us, events, authors, actors) found from left to right: from each event those within
    `width` of it; a window that is large enough is taken and the scan goes on behind it. Windows no more than merge_gap
    apart are joined.

    The stream needs no pauses. It is cut into slices of consecutive rows, which also see the rows that a window of
    theirs can reach. Where a scan that enters a slice leaves it depends on the place of entry alone, and only rows
    within a window of the slice's beginning can be entered first. These jumps are joined with themselves, so that jumps double
    in length and as many rounds as the logarithm of the number of slices find the places where the one true scan enters;
    then all slices are scanned at once. Windows joined over slices meet by running sums with one row a slice.
    """
    placed, sizes, lasts = _sliced(events, rows_a_slice)
    spark, schema = events.sparkSession, "start_us bigint, end_us bigint, events int, authors int, actors array<string>"
    if not len(sizes):
        return spark.createDataFrame([], schema)
    base = np.concatenate([[0], np.cumsum(sizes)])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, us, place = (batch.column(c).to_numpy() for c in ("slice", "us", "place"))
            first = np.minimum(np.searchsorted(lasts, us - width), of)
            times = of - first + 1
            row = np.repeat(np.arange(len(of)), times)
            into = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            moved = batch.select(["author", "us"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(base[of[row]] + place[row]), pa.array(into), pa.array(into == of[row])], ["author", "us", "at", "slice", "own"])

    seen = placed.mapInArrow(reach, "author string, us bigint, at bigint, slice bigint, own boolean")

    def jumps(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("at", kind="stable")
        own, start = int(t["own"].sum()), int(t["at"].iloc[0])
        ends, taken = _scan(t, own, width, least, least_authors)
        exit_ = np.where(taken, ends, np.arange(1, own + 1)).tolist()
        for i in range(own - 1, -1, -1):
            if exit_[i] < own:
                exit_[i] = exit_[exit_[i]]
        us = t["us"].to_numpy()
        entries = min(own, int(np.searchsorted(us, us[0] + width, "right")) + 1)
        return pd.DataFrame({"entry": np.arange(start, start + entries), "exit": np.array(exit_[:entries], np.int64) + start})

    total = int(base[-1])
    entered = spark.createDataFrame([(0,)], "at bigint")
    if len(sizes) > 1:
        jump = stored(seen.groupBy("slice").applyInPandas(jumps, "entry bigint, exit bigint").filter(F.col("exit") < total))
        while not jump.isEmpty():
            entered = stored(entered.union(entered.join(jump, F.col("at") == F.col("entry")).select("exit")).distinct())
            on = jump.select(F.col("entry").alias("exit"), F.col("exit").alias("beyond"))
            jump = stored(jump.join(on, "exit").select("entry", F.col("beyond").alias("exit")))
    number = F.array(*[F.lit(int(x)) for x in base[1:]]) if len(sizes) <= 1000 else None
    if number is not None:
        entered = entered.select("at", F.size(F.filter(number, lambda x: x <= F.col("at"))).cast("long").alias("slice"))
    else:
        entered = entered.mapInPandas(lambda ts: (t.assign(slice=np.searchsorted(base, t["at"].to_numpy(), "right") - 1) for t in ts), "at bigint, slice bigint")

    def windows(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(start) and len(rows):
            t = rows.sort_values("at", kind="stable")
            own = int(t["own"].sum())
            ends, taken = _scan(t, own, width, least, least_authors)
            us, author = t["us"].to_numpy(), t["author"].to_numpy()
            i, ends, taken = int(start["at"].iloc[0]) - int(t["at"].iloc[0]), ends.tolist(), taken.tolist()
            while i < own:
                if taken[i]:
                    out.append([int(us[i]), int(us[ends[i] - 1]), ends[i] - i, set(author[i : ends[i]])])
                    i = ends[i]
                else:
                    i += 1
        joined: list[list] = []
        for w in out:
            if merge_gap is not None and joined and w[0] - joined[-1][1] <= merge_gap:
                joined[-1][1], joined[-1][2], joined[-1][3] = w[1], joined[-1][2] + w[2], joined[-1][3] | w[3]
            else:
                joined.append(w)
        return pd.DataFrame([(key[0], k, a, b, n, sorted(who)) for k, (a, b, n, who) in enumerate(joined)], columns=["slice", "k", "start_us", "end_us", "events", "actors"])

    found = seen.groupBy("slice").cogroup(entered.groupBy("slice")).applyInPandas(windows, "slice bigint, k int, start_us bigint, end_us bigint, events int, actors array<string>")
    if merge_gap is None or len(sizes) == 1:
        return found.select("start_us", "end_us", "events", F.size("actors").alias("authors"), "actors")
    found = stored(found)
    by = W.orderBy("slice")  # one row a slice from here
    ends = found.groupBy("slice").agg(F.max("end_us").alias("end"), F.min("start_us").alias("start"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumn("follows", (F.col("start") - F.lag("end").over(by) <= merge_gap).cast("int")).fillna(0, ["follows"])
    ends = ends.select("slice", (F.sum(F.col("n") - F.col("follows")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    g = found.join(ends, "slice").groupBy((F.col("before") + F.col("k")).alias("g"))
    merged = g.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").cast("int").alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("actors")))).alias("actors"))
    return merged.select("start_us", "end_us", "events", F.size("actors").alias("authors"), "actors")


def leader_clusters(vectors: DataFrame, key: str, terms: str, threshold: float, running: bool, most: int | None = None) -> DataFrame:
    """Leader clustering of sparse vectors (map term -> weight): in order of key, a row joins the most similar
    leader at or above the cosine threshold, else it leads. The leader is the first member, or with
    `running` the mean of the members. The method is sequential: all rows stream through one task, which
    holds the leaders only (the first `most` rows by key, where a caller states a limit).
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(terms).alias("v"))
    rows = (rows if most is None else rows.orderBy("k").limit(most)).repartition(1).sortWithinPartitions("k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders: list[dict] = []
        norms: list[float] = []
        sizes: list[int] = []
        # term -> leader -> weight: only leaders that share a term are compared
        places: dict[str, dict[int, float]] = {}
        norm = lambda v: sum(x * x for x in v.values()) ** 0.5
        for t in batches:
            out = []
            for k, items in zip(t["k"], t["v"], strict=True):
                v = dict(items)
                n = norm(v)
                dots: dict[int, float] = {}
                for w, x in v.items():
                    for i, y in places.get(w, {}).items():
                        dots[i] = dots.get(i, 0.0) + x * y
                best, at = 0.0, -1
                for i in sorted(dots):
                    s = dots[i] / (n * norms[i]) if n and norms[i] else 0.0
                    if s > best:
                        best, at = s, i
                if at < 0 or best < threshold:
                    leaders.append(dict(v))
                    norms.append(n)
                    sizes.append(1)
                    at = len(leaders) - 1
                    for w, x in v.items():
                        places.setdefault(w, {})[at] = x
                elif running:
                    c, m = leaders[at], sizes[at]
                    for w in set(c) | set(v):
                        c[w] = (c.get(w, 0.0) * m + v.get(w, 0.0)) / (m + 1)
                        places.setdefault(w, {})[at] = c[w]
                    norms[at], sizes[at] = norm(c), m + 1
                out.append((k, at, float(best)))
            yield pd.DataFrame(out, columns=["k", "cluster", "similarity"])

    kind = vectors.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"k {kind}, cluster int, similarity double").withColumnRenamed("k", key)


def merge_pairs(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Teams from pairs (a, b, posts), strongest first: a pair of free actors founds a team, a pair of one member and
    a free actor extends its team; pairs across teams don't join them. All pairs stream through one task, whose state is one entry an actor (the `most` strongest,
    where a caller states a limit)."""
    order = [F.desc("posts"), "a", "b"]
    rows = (pairs if most is None else pairs.orderBy(*order).limit(most)).repartition(1).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        team: dict[str, int] = {}
        n = 0
        for a, b in (pair for t in batches for pair in zip(t["a"], t["b"], strict=True)):
            if a not in team and b not in team:
                team[a] = team[b] = n
                n += 1
            elif a in team and b not in team:
                team[b] = team[a]
            elif b in team and a not in team:
                team[a] = team[b]
        yield pd.DataFrame(list(team.items()), columns=["author", "team"])  # a dict of empty lists would be of floats

    return rows.mapInPandas(run, "author string, team int")


def betweenness(edges: DataFrame, sources: DataFrame, most_edges: int | None = 200_000) -> DataFrame:
    """Weighted shortest-path betweenness over the given sources (node): Brandes' method, one source at a time and
    sources in parallel. Distances are 1 / weight. The edge list is shared with the tasks as arrays of 12 bytes an
    edge and direction; more than most_edges edges are refused (None refuses none)."""
    import heapq

    rows = edges.select("a", "b", F.col("weight").cast("double"))
    rows = (rows if most_edges is None else rows.limit(most_edges + 1)).toArrow()
    if most_edges is not None and len(rows) > most_edges:
        raise ValueError(f"betweenness takes at most {most_edges} edges; filter or sample the graph first")
    ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code, names = ends.indices.to_numpy(), ends.dictionary.to_pylist()
    of, to = code, np.roll(code, len(rows))
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(names) + 1))
    length = 1 / np.tile(rows["weight"].to_numpy(), 2)
    shared = edges.sparkSession.sparkContext.broadcast((names, start, to[order].astype(np.int32), length[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, start, to, length = shared.value
        number = {x: i for i, x in enumerate(names)}
        for t in batches:
            total: dict[int, float] = {}
            for s in [number[x] for x in t["node"] if x in number]:
                dist, count, before, order = {}, {s: 1.0}, {s: []}, []
                best = {s: 0.0}
                heap = [(0.0, s)]
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in dist:
                        continue
                    dist[v] = d
                    order.append(v)
                    for u, w in zip(to[start[v] : start[v + 1]].tolist(), length[start[v] : start[v + 1]].tolist(), strict=True):
                        e = d + w
                        if u in dist:
                            continue
                        if u not in best or e < best[u] - 1e-12:
                            best[u], count[u], before[u] = e, count[v], [v]
                            heapq.heappush(heap, (e, u))
                        elif abs(e - best[u]) <= 1e-12:
                            count[u] += count[v]
                            before[u].append(v)
                share = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += count[u] / count[v] * (1 + share[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + share[v]
            yield pd.DataFrame([(names[v], x) for v, x in total.items()], columns=["node", "part"])

    parts = sources.select("node").distinct().repartition(8).mapInPandas(run, "node string, part double")
    return parts.groupBy("node").agg((F.sum("part") / 2).alias("betweenness"))
