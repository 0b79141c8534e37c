"""Fingerprints, their table and the join of like ones against plain Python."""

import math
import random
import statistics

import numpy as np

from murmuration.operators import identity


def test_fingerprint_of_eight_features(spark):
    texts = {"ana": ["FUERA ya, fuera!!", "el narco 123 no", "ok 😀 ok", "uno dos tres cuatro", "Ñandú NO.  sí"], "few": ["solo"], "bot": ["hola"], "?": ["x"] * 9}
    rows = [(a, t) for a, ts in texts.items() for t in ts] + [("ana", None), ("ana", "  ")]
    c = spark.createDataFrame(rows, "author string, text string").repartition(3)
    got = {r.author: (r.n, r.fingerprint) for r in identity.fingerprints(c, 5, spark.createDataFrame([("bot",)], "author string")).collect()}
    assert set(got) == {"ana", "bot"} and got["bot"] == (1, [1.0, 0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    ts = texts["ana"]
    words, chars = " ".join(ts).lower().split(), len(" ".join(ts))
    want = [len(set(words)) / len(words), len(words) / 5 / 50, 2 / len(words), 1 / 5, 4 / chars * 10, 3 / 5, 3 / chars * 5, statistics.pstdev(len(t.split()) for t in ts) / 20]
    assert got["ana"][0] == 5 and got["ana"][1] == [round(x, 4) for x in want]
    assert identity.fingerprints(c.limit(0)).count() == 0


def test_cosine_join_equals_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = [(f"u{k}", (r.normal(size=5) * (1 if k % 3 else -2)).tolist()) for k in range(80)] + [("zero", [0.0] * 5), ("null", None), ("u0", [1.0, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "author string, v array<double>").repartition(3)
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    some = [(a, v) for a, v in rows if v and any(v)]
    for bar in (0.5, 0.93):
        got = sorted((x.l.author, x.r.author, x.cosine) for x in identity.cosine_matches(df, df, "v", bar).collect())
        want = sorted((a, b, round(cosine(x, y), 4)) for a, x in some for b, y in some if round(cosine(x, y), 4) >= bar)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want, strict=True))
    assert identity.cosine_matches(df.limit(0), df, "v", 0.5).count() == 0


def test_table_of_fingerprints_and_morphs(spark, tmp_path):
    path, f = str(tmp_path / "prints"), [0.5, 0.1, 0.0, 0.0, 0.3, 0.0, 0.0, 0.1]
    found = spark.createDataFrame([("Ana", 5, f), ("ana ", 6, f), ("Beto", 7, [0.1, 0.9, 0.0, 0.0, 0.0, 0.4, 0.0, 0.0])], "author string, n bigint, fingerprint array<double>")
    assert identity.history(spark, path) is None
    assert [identity.remember(spark, path, found, c, s) for c, s in ((" one", "s1"), ("ONE", "s1"), ("one", "s2"), ("two", "s1"))] == [2, 0, 2, 2]
    past = identity.history(spark, path)
    assert past.count() == 6 and {r.campaign for r in past.collect()} == {"ONE", "TWO"}
    now = spark.createDataFrame([("Carla", 9, f, "one"), ("ANA", 9, f, "three"), ("Zoe", 5, [0.0] * 8, "three")], "author string, n bigint, fingerprint array<double>, campaign string")
    got = sorted((x.now, x.was, x.campaign, x.identity) for x in identity.morphs(now, past).collect())
    assert got == [("Carla", "Ana", "TWO", "CONFIRMED")]
    row = identity.persistence(now, identity.morphs(now, past)).first()
    assert (row.actors, row.pairs, row.confirmed, row.operators, row.score) == (3, 1, 1, 2, 45.0)
    assert identity.persistence(now, identity.morphs(now.limit(0), past)).first().score == 0


def test_cosines_that_round_up_to_the_bar_count(spark):
    left = spark.createDataFrame([("l", [1.0, 0.0])], "author string, v array<double>")
    right = spark.createDataFrame([("in", [0.74997, math.sqrt(1 - 0.74997**2)]), ("out", [0.74994, math.sqrt(1 - 0.74994**2)])], "author string, v array<double>")
    assert [(r.r.author, r.cosine) for r in identity.cosine_matches(left, right, "v", 0.75).collect()] == [("in", 0.75)]
