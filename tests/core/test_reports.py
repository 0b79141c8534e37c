"""Numbers over ranges, rows of sessions, terms of clusters, summaries."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from murmuration.operators import reports, risk, text
from murmuration.plans.joins import numbered
from murmuration.sources import sessions


def test_places_go_on_from_range_to_range(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(40)) for _ in range(500)] + [("a", 7)] * 300
    df = spark.createDataFrame(rows, "k string, x int").withColumn("size", F.lit(1)).repartition(7)
    got = sorted((r.place_of, r.k, r.x) for r in numbered(df, ["k", "x"], "place_of").collect())
    want = sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", t[1]))
    assert got == [(i + 1, *t) for i, t in enumerate(want)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_numbers_of_items_are_not_cut(spark):
    items = spark.range(10_050).select(F.lit("SEED").alias("category"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.lit("d").alias("detail"))
    got = {r.key: r.item_id for r in risk.evidence_manifest(items, "case").filter("key in ('000000', '009998', '010049')").collect()}
    assert got == {"000000": "case-0001", "009998": "case-9999", "010049": "case-10050"}


def test_sessions(spark, tmp_path):
    posts = spark.createDataFrame([("s1", "NEGATIVE"), ("s1", "AGGRESSIVE"), ("s1", None), ("s2", "NEUTRAL")], "session_id string, label string")
    path = str(tmp_path / "sessions")
    for at in ("2026-01-02", "2026-01-01"):
        sessions.append_sessions(sessions.session_rows(posts, ["session_id"], ["q"], "m", 7, at), path)
    sessions.append_sessions(sessions.session_rows(posts.filter("session_id = 's2'"), ["session_id"], [], "m", 1, "2026-01-03"), path)
    table = spark.read.parquet(path)
    assert table.count() == 5
    got = {r.session_id: (r.queries, r.timestamp, r.days, r.post_count, r.neg_count) for r in sessions.last_sessions(table, ["session_id"]).collect()}
    assert got == {"s1": (["q"], "2026-01-02", 7, 3, 2), "s2": ([], "2026-01-03", 1, 1, 0)}


def test_terms_of_centroids(spark):
    r = random.Random(2)
    w = [(k, t, round(r.random(), 6)) for k in range(12) for t in "abcdef" if r.random() < 0.6] + [(99, "a", 1.0)]
    of = {k: k % 3 for k in range(13)}  # 12 has no term, 99 no cluster
    got = defaultdict(list)
    rows = text.centroid_terms(spark.createDataFrame(w, "id long, term string, weight double"), spark.createDataFrame(list(of.items()), "id long, cluster long"), "id", 3)
    for x in rows.orderBy("cluster", F.desc("mean"), "term").collect():
        got[x.cluster].append((x.term, x.mean))
    for c in range(3):
        n = sum(v == c for v in of.values())
        means = {t: round(sum(x for k, u, x in w if u == t and of.get(k) == c) / n, 6) for t in "abcdef" if any(u == t and of.get(k) == c for k, u, _ in w)}
        assert [(t, round(m, 5)) for t, m in got[c]] == [(t, round(m, 5)) for t, m in sorted(means.items(), key=lambda kv: (-kv[1], kv[0]))[:3]]


def test_summary(spark):
    c = spark.createDataFrame([(1, 4, 10.0, None, None), (2, 0, 0.0, "NEW_BOTS", "HIGH"), (3, 9, 85.0, "CIB_SPIKE", "CRITICAL"), (4, 1, 2.0, None, None)], "hour long, posts long, score double, alert string, severity string")
    assert tuple(reports.monitor_summary(c, "hour").first()) == (4, 14, 2, 1, 1, 85.0, 3)
    assert reports.monitor_summary(c.limit(0), "hour").first().cycles == 0
