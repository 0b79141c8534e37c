"""Key figures against loops over small rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from murmuration.operators import figures


def _rows(seed, posts=14, actors=12):
    r = random.Random(seed)
    return [(f"p{r.randrange(posts)}", f"a{r.randrange(actors)}") for _ in range(90)]


def _operators(rows, bots, suspects, least_posts=2, least_bots=2):
    on = defaultdict(set)
    for url, a in rows:
        if a not in (None, "?"):
            on[url].add(a)
    met = defaultdict(set)
    for url, who in on.items():
        for b in who & bots:
            for o in who - bots:
                if suspects is None or o in suspects:
                    met[b, o].add(url)
    met = {k: v for k, v in met.items() if len(v) >= least_posts}
    beside, out = defaultdict(set), {}
    for b, o in met:
        beside[b].add(o)
    for o in {o for _, o in met}:
        mine = {b for b, x in met if x == o}
        if len(mine) < least_bots:
            continue
        posts = len(set().union(*[met[b, o] for b in mine]))
        ex = round(sum(len(beside[b]) == 1 for b in mine) / len(mine), 3)
        conf = min(100, int(round(min(100, posts * 5) * 50 / 100 + ex * 100 * 50 / 100, 9)))
        out[o] = (len(mine), posts, ex, conf, "CONFIRMED" if conf >= 70 else "LIKELY" if conf >= 40 else "POSSIBLE")
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_operators_equal_a_loop(spark, seed):
    rows = _rows(seed) + [("p1", "?"), ("p1", None), ("p2", "a1"), ("p2", "a1")]
    bots, suspects = {"a0", "a1", "a2", "a3"}, {f"a{k}" for k in range(4, 9)}
    c = spark.createDataFrame(rows, "url string, author string").withColumn("bot", F.lit(1))  # an extra column of a clashing name
    b = spark.createDataFrame([(x,) for x in bots] * 2, "author string")
    for only in (None, suspects):
        s = None if only is None else spark.createDataFrame([(x,) for x in only], "author string")
        got = {r.operator: (r.bots, r.posts, r.exclusivity, r.confidence, r.operation) for r in figures.attributed_operators(c, b, s).collect()}
        assert got == _operators(rows, bots, only)


def test_attribution_score(spark):
    ops = spark.createDataFrame([(f"o{k}", 30 if k else 2, 80 if k < 3 else 50, "CONFIRMED" if k < 3 else "LIKELY") for k in range(20)], "operator string, bots long, confidence int, operation string")
    assert tuple(figures.attribution_score(ops).first()) == (15, 74.0)  # 3 * 8, and 5 * (2 + 14 * 20) / 15 is over 50
    assert tuple(figures.attribution_score(ops.limit(0)).first()) == (0, 0.0)


def _windows(spark, rows):
    return spark.createDataFrame(rows, "url string, pre double, during double, post double")


def test_direction(spark):
    flat = _windows(spark, [("a", 0.1, 0.1, 0.1)])
    up = _windows(spark, [("a", 0.1, 0.2, 0.2), ("b", None, 0.3, 0.5), ("c", 0.3, None, None)])  # 0.2 before, 0.35 after
    say = lambda n, p: figures.contagion_direction(n, p).first().direction
    assert [say(flat, flat), say(up, flat), say(flat, up), say(up, up)] == ["NONE", "NEGATIVE", "POSITIVE", "MIXED"]
    assert say(_windows(spark, [("a", None, 0.2, None)]), flat) == "NEGATIVE"  # during stands for after, nothing before
    assert say(flat.limit(0), flat.limit(0)) == "NONE"


def test_rotated_actors_count_once(spark):
    m = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "d"), (5, "c"), (7, "z")], "cohort long, author string")
    s = spark.createDataFrame([(0, 1, "LOW"), (1, 2, "HIGH"), (2, 5, "NONE")], "cohort long, next long, shift string")
    assert sorted(r.author for r in figures.rotated_actors(m, s).collect()) == ["a", "b", "c"]


def test_narratives(spark):
    said = [(k, a) for k, a in enumerate(["x", "x", "y", "x", "y", "z", "x", "y", "w", "w", "w", "q"])]
    rows = spark.createDataFrame(said, "id long, author string")
    clusters = spark.createDataFrame([(k, k // 3) for k in range(11)], "id long, cluster int")  # the last one holds two rows, row 11 none
    bots = spark.createDataFrame([("x",), ("w",), ("w",)], "author string")
    got = {r.cluster: (r.size, r.bot_share, r.label) for r in figures.narrative_clusters(rows, clusters, bots, "id").collect()}
    assert got == {0: (3, 0.667, "BOT_DOMINATED"), 1: (3, 0.333, "MIXED"), 2: (3, 0.667, "BOT_DOMINATED")}
    roles = figures.narrative_roles(rows, clusters, bots, "id")
    assert {r.author: (r.clusters, r.role) for r in roles.collect()} == {"x": (3, "AMPLIFIER"), "y": (3, "AMPLIFIER"), "z": (1, "ORGANIC"), "w": (1, "SOLDIER")}
    one = figures.narrative_score(figures.narrative_clusters(rows, clusters, bots, "id"), roles).first()
    assert (one.dominated, one.amplifiers, one.soldiers, one.score) == (2, 2, 1, 50.0)


def test_injections(spark):
    n = spark.createDataFrame([(0, 9, 3, 60), (1, 2, 1, 60), (2, 2, 1, 39)], "cluster int, size long, posts long, score int")
    assert tuple(figures.injection_score(n).first()) == (2, 5 * 2 + 3 * 9 + 5 * 3)
    assert tuple(figures.injection_score(n.limit(0)).first()) == (0, 0.0)


def test_topology(spark):
    n = spark.createDataFrame([(f"n{k:02}", 100.0 - k, k % 5 == 0) for k in range(40)], "node string, influence double, suspect boolean")
    one = figures.topology_score(spark.createDataFrame([(0.5,)], "gini double"), n, spark.createDataFrame([(99,)], "coordination int")).first()
    assert (one.suspect_share, one.score) == (0.2, 52.0)


def test_one_row_of_figures(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    w = spark.createDataFrame([("MIXED",)], "d string")
    names = ["total_posts", "bot_pct", "contagion_direction", "neg_pct"]
    got = figures.figures([(a, {"total_posts": F.sum("x"), "neg_pct": F.max("x")}), (w, {"contagion_direction": F.max("d")})], names)
    assert got.columns == names and tuple(got.first()) == (3.0, 0.0, "MIXED", 2.0)
    none = figures.figures([(a.limit(0), {"total_posts": F.sum("x")}), (w.limit(0), {"contagion_direction": F.max("d")})])
    assert len(none.columns) == 63 and none.first().contagion_direction == "NONE" and none.first().total_posts == 0.0
    with pytest.raises(ValueError):
        figures.figures([(a, {"unheard": F.sum("x")})])


def test_every_figure_has_a_source():
    from murmuration import catalogue_figures as c

    given = [n for wanted in (c.TAKEN | c.REST).values() for n in wanted] + ["narrative_score"]
    assert sorted(given) == sorted(figures.FIGURES)
