"""Signals, profiles, names and chains on small tables."""

import pytest
from pyspark.sql import functions as F

from murmuration.operators import trolls

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def comments(spark):
    rows = [("Ana López", f"p{k}", "gracias, buen trabajo", k * 10 * HOUR) for k in range(2)]
    rows += [("user77", f"p{k}", t, k * HOUR // 100) for k, t in enumerate(["Pendejo corrupto jaja", "fuera ya", "RATERO", "hola", "nada más", "puta madre"])]
    rows += [("Noticias DEL Norte 24", "p1", "la voz del pueblo", None), ("Ana López", "p9", "", 0), ("?", "p1", "fuera", 0), ("Ana López", "p9", None, 0), ("boss", "p1", "hola", 5)]
    return spark.createDataFrame(rows, "author string, url string, text string, us long").repartition(2)


def test_signals_are_computed_from_comments(spark, comments):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "author string")
    linked = spark.createDataFrame([("boss", "boss"), ("x", "boss"), ("y", "boss"), ("z", "boss"), ("user77", "user77"), ("w", "user77")], "node string, leader string")
    s = trolls.actor_signals(comments, one("user77", "user77"), one("Ana López"), linked, ["noticias", "la voz"])
    got = {(r.author, r.signal): (round(r.value, 4), r.weight, r.severity) for r in s.collect()}
    # three comments with an insult, one meme, three with an attacking word, of six; insults and attacks may be one word
    aggression = (3 + 1 + 3) / 18
    assert got == {
        ("user77", "S4_AGG"): (round(aggression, 4), 22, "MEDIUM"), ("user77", "S5_CROSS"): (0.6, 18, "CRITICAL"), ("user77", "S6_VEL"): (1.0, 18, "CRITICAL"),
        ("user77", "S7_COORD"): (0.75, 20, "CRITICAL"), ("user77", "S8_PROFILE"): (0.6, 15, "MEDIUM"),
        ("Ana López", "S7_COORD"): (0.85, 20, "CRITICAL"), ("boss", "S3_MULTI"): (0.6, 25, "CRITICAL"),
        ("Noticias DEL Norte 24", "S2_PAGE"): (1.0, 22, "HIGH"), ("Noticias DEL Norte 24", "S8_PROFILE"): (0.6, 15, "MEDIUM"),
    }
    p = {r.author: r for r in trolls.actor_profiles(s).collect()}
    raw = aggression * 22 + 0.6 * 18 + 18 + 15 + 9
    assert p["user77"].risk == max(75, round(raw / 170 * 100)) and p["user77"].classification == "HIGH_RISK" and p["user77"].critical == 3
    assert p["Ana López"].risk == 10 and p["boss"].classification == "HUMAN" and p["Noticias DEL Norte 24"].risk == round((22 + 9) / 1.7)
    score = trolls.hunt_score(trolls.actor_profiles(s)).first()
    assert (score.actors, score.confirmed, score.high_risk) == (4, 0, 1) and score.score == round(0.5 * (75 + 10 + 9 + 18) / 4, 1)
    assert trolls.hunt_score(trolls.actor_profiles(s.limit(0))).first().score == 0
    none = comments.limit(0)
    assert trolls.actor_signals(none, one("a"), one("a"), linked, []).count() == 0


def test_page_scores(spark):
    names = {"Noticias Culiacán": 0.55, "EL SOL": 0.75, "Ana de López": 0.0, "Uno Dos Tres": 0.2, "a b c d e": 0.2, "Canal 44": 0.15, "x": 0.0, "": 0.0, None: 0.0}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "n string, want double")
    got = {r.n: r.s for r in df.select("n", F.coalesce(trolls.page_score(F.col("n"), ["noticias", "el sol"]), F.lit(0.0)).alias("s")).collect()}
    assert got == names


def test_names_meet_the_table(spark):
    table = [("Al-", "prefix", "P", 0.9, 2), ("ov", "suffix", "S", 0.7, 3), ("nov", "suffix", "L", 0.7, 3), ("ana", "first", "F", 0.95, 1), ("perez", "last", "Z", 0.8, 4), ("luz", "any", "M", 0.5, 5)]
    names = ["Ana Ivanov", "Ivan Ivanov", "Rosa Al-Bahr", "perez", "Juan PEREZ", "Ivan ov", "Sol Luz Mar", "", None, "Ivan Ivanov"]
    df = spark.createDataFrame([(n,) for n in names], "author string")
    got = {r.name: (r.label, r.matched) for r in trolls.name_lookup(df, spark.createDataFrame(table, "part string, place string, label string, confidence double, priority int")).collect()}
    assert got == {"Ana Ivanov": ("F", "ana"), "Ivan Ivanov": ("L", "nov"), "Rosa Al-Bahr": ("P", "al-"), "Juan PEREZ": ("Z", "perez"), "Sol Luz Mar": ("M", "luz")}


def test_evidence_of_all_engines_folds_in_one_table(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    signals = make([("a", 3, 3, "S5_CROSS", 0.6, 18, "CRITICAL"), ("b", 1, 1, "S8_PROFILE", 0.6, 15, "MEDIUM")], "author string, n long, posts long, signal string, value double, weight int, severity string")
    found = trolls.evidence(
        signals, velocity=make([("a", "BOT_VELOCITY"), ("b", "SUSPICIOUS"), ("c", "NORMAL")], "author string, velocity_label string"), waves=make([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("b", 1)], "author string, wave int"),
        clones=make([("a", "x"), ("a", "y"), ("a", "z")], "author string, other string"), copies=make([("a",), ("b",)], "author string"), confidence=make([("a", 39), ("b", 10), ("c", 90)], "author string, hcs int"),
        campaigns=make([("a", "PROFESSIONAL"), ("b", "RECURRENT")], "author string, classification string"), morphs=make([("a", "PROBABLE"), ("a", "CONFIRMED"), ("b", "PROBABLE")], "now string, identity string"),
        hijacks=make([("a", 2), ("b", 1)], "author string, hijacks int"), shifts=make([("b",), ("b",)], "author string"),
    )
    got = sorted((r.author, r.signal, r.points, r.severity) for r in found.collect())
    assert got == sorted([
        ("a", "S5_CROSS", 18, "CRITICAL"), ("b", "S8_PROFILE", 15, "MEDIUM"), ("a", "N4_VEL", 20, "CRITICAL"), ("b", "N4_VEL", 12, "HIGH"), ("a", "E7_TW", 18, "CRITICAL"), ("b", "E7_TW", 12, "HIGH"),
        ("a", "E1_SF", 15, "HIGH"), ("a", "E1_SF", 15, "HIGH"), ("b", "E1_CP", 12, "HIGH"), ("a", "HCS_LOW", 10, "MEDIUM"), ("b", "HCS_LOW", 10, "HIGH"), ("a", "E6_CC", 20, "CRITICAL"), ("b", "E6_CC", 14, "HIGH"),
        ("a", "E1_ID", 18, "CRITICAL"), ("b", "E1_ID", 12, "HIGH"), ("a", "E2_RH", 12, "HIGH"), ("b", "E7_BS", 10, "HIGH"),
    ])
    profiles = make([("a", 70, "HIGH_RISK"), ("b", 10, "HUMAN"), ("d", 30, "LIKELY_HUMAN")], "author string, risk int, classification string")
    c = {r.author: r for r in trolls.chains(found, profiles, most=3).collect()}
    assert c["a"].chain == "E6_CC:20,N4_VEL:20,E1_ID:18" and (c["d"].signals, c["d"].chain) == (0, "") and "b" not in c
