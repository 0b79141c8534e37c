"""Cycles of a stream against a loop that keeps the same state, with a stop in between and late rows."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from murmuration.streaming import cycles, monitor

SCHEMA = "campaign string, ts timestamp, author string, text string, engagement double, risk double, score double"
EVERY = 60
ZERO = datetime(2026, 1, 1, tzinfo=timezone.utc)
WORDS = "hoax riot fraud truth vote leak army money para gang bomb flag news".split()


def _posts(seed, cycles_of):
    r, out = random.Random(seed), []
    for campaign, active in cycles_of.items():
        for k in active:
            for _ in range(r.randrange(1, 9)):
                out.append({"campaign": campaign, "ts": ZERO + timedelta(seconds=k * EVERY + r.randrange(EVERY)), "author": r.choice([None, "a", "b", "c", "d", "e"]),
                            "text": r.choice([None, "", " ".join(f"{r.choice(WORDS)}{r.choice(['', '!', ','])}" for _ in range(4))]), "engagement": r.choice([None, 0.0, 5.0, 90.0]), "risk": r.choice([None, 10.0, 60.0, 90.0]), "score": r.choice([None, 10.0, 50.0, 85.0])})
    return sorted(out, key=lambda p: p["ts"])


def _loop(posts, last):
    """campaign -> rows; a cycle without posts right behind one with posts is a row as well."""
    out = []
    for campaign in {p["campaign"] for p in posts}:
        by = {}
        for p in posts:
            if p["campaign"] == campaign:
                by.setdefault(int((p["ts"] - ZERO).total_seconds()) // EVERY, []).append(p)
        number, bots, words, score, mean, seen = 0, set(), set(), 0.0, None, False
        for k in range(min(by), last):
            now = by.get(k, [])
            if not now and not seen:
                continue
            counts = Counter()
            for p in now:
                for w in (p["text"] or "").lower().split():
                    w = w.strip(".,;:!?()[]\"'@#/\\")
                    if len(w) >= 4 and w not in cycles.STOP:
                        counts[w] += 1
            top = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]}
            risky = {p["author"] for p in now if p["author"] and (p["risk"] or 0) >= 60}
            eng, top_score = sum(p["engagement"] or 0 for p in now) / max(len(now), 1), max([p["score"] or 0 for p in now], default=0.0)
            number += 1
            out.append((campaign, k + 1, number, len(now), top_score, score, round(eng, 6), round(eng if mean is None else mean, 6), len(risky - bots), len(top - words)))
            bots, words, score, mean, seen = risky, top, top_score, eng, bool(now)
    return sorted(out)


def _write(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(p | {"ts": p["ts"].strftime("%Y-%m-%dT%H:%M:%SZ")}) for p in rows))


def test_cycles_go_on_after_a_stop_and_drop_late_rows(spark, tmp_path):
    posts = _posts(4, {"x": [0, 1, 2, 3, 4, 8, 9], "y": [1, 3, 4, 5, 6], "z": [5]})
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        q = cycles.cycles(stream, EVERY, "1 second", top=3, shards=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    cut = [p for p in posts if p["ts"] < ZERO + timedelta(seconds=3.5 * EVERY)]
    _write(folder, "1", cut)
    run()
    late = [dict(p, author="late", risk=99.0, engagement=1e6, score=99.0) for p in cut[:5]]
    lost = [dict(posts[0], campaign=None)]
    _write(folder, "2", [p for p in posts if p not in cut] + lost)
    run()
    _write(folder, "3", late + [dict(posts[0], campaign="end", ts=ZERO + timedelta(seconds=100 * EVERY))])
    run()
    rows = spark.read.parquet(out).withColumn("k", (F.unix_seconds("cycle") - int(ZERO.timestamp())) / EVERY)
    got = sorted((r.campaign, int(r.k), r.number, r.posts, r.score, r.old_score, round(r.engagement, 6), round(r.old_engagement, 6), r.new_bots, r.new_terms) for r in rows.collect())
    assert got == _loop(posts, 50)
    assert {r.severity for r in rows.filter("alert is null").collect()} <= {None} and rows.filter("alert is not null").count() > 0


def test_rules_of_alerts(spark):
    cols = "new_bots long, new_terms long, score double, old_score double, engagement double, old_engagement double"
    rows = [(10, 0, 0.0, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0, 0.0), (10, 0, 40.0, 25.0, 0.0, 0.0), (0, 9, 80.0, 0.0, 0.0, 0.0), (0, 4, 0.0, 0.0, 0.0, 0.0), (0, 0, 0.0, 0.0, 0.5, 0.0), (0, 0, 0.0, 0.0, 14.9, 10.0), (2, 3, 39.0, 0.0, 0.0, 0.0)]
    kind, severity = monitor.alert_of()
    got = [tuple(r) for r in spark.createDataFrame(rows, cols).select(kind, severity).collect()]
    assert got == [("NEW_BOTS", "CRITICAL"), ("NEW_BOTS", "HIGH"), ("NEW_BOTS", "HIGH"), ("CIB_SPIKE", "CRITICAL"), ("NARRATIVE_PIVOT", "MEDIUM"), ("ENGAGEMENT_SURGE", "MEDIUM"), (None, "INFO"), (None, "INFO")]
