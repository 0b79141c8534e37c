"""Pairs of actors that are made once, and ranks that need no pairs."""

from itertools import combinations

from murmuration.operators import graph, models, registry
from murmuration.plans import products

HOUR = 3_600_000_000


def events(spark):
    rows = [(f"u{(k * 7 + n) % 5}", k, f"a{n}", (n * k * 5 % 24) * HOUR, "x") for n in range(9) for k in range(n % 4 + 1)] + [("alone", 99, "solo", 0, "x")]
    return spark.createDataFrame(rows, "url string, pos long, author string, us long, action string")


def test_hours_are_counted_in_blocks(spark, monkeypatch):
    c, used = events(spark), []
    monkeypatch.setattr(models.products, "block_products", lambda *a, f=products.block_products: used.append(1) or f(*a))
    got = {(r.a, r.b): (r.both, r.anticorrelation) for r in models.hour_occupancy(c).collect()}
    hours: dict = {}
    for r in c.collect():
        hours.setdefault(r.author, set()).add(r.us // HOUR)
    want = {(a, b): (len(x & y), round(len(x ^ y) / len(x | y), 4)) for a, b in combinations(sorted(hours), 2) if (x := hours[a]) & (y := hours[b])}
    assert got == want and used


def test_sockpuppets_from_one_product(spark):
    c = events(spark)
    counts = c.groupBy("author", "url").count().toDF("author", "token", "n")
    shares = counts.withColumn("share", graph.F.col("n") / graph.F.sum("n").over(graph.W.partitionBy("author")))
    p = models.style_and_hours(counts, c)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(models.sockpuppets(p, p)) == rows(models.sockpuppets(models.style_delta(shares, "author"), models.hour_occupancy(c))) != []


def test_pagerank_makes_no_edges(spark, monkeypatch):
    c = events(spark)
    want = {r.node: round(r.rank, 9) for r in graph.pagerank(graph.co_occurrence(c, None), 5, weight="posts").collect()}
    from murmuration import catalogue

    monkeypatch.setattr(graph, "co_occurrence", None)
    monkeypatch.setattr(catalogue.tables, "events", lambda spark, sf_dir: c)
    assert {r.node: round(r.rank, 9) for r in graph.member_pagerank(c, 5).collect()} == want and "solo" not in want
    assert {r.node: r.rank for r in catalogue.pagerank(spark, "").collect()} == {k: round(v, 6) for k, v in want.items()}


def test_fingerprints_meet_in_blocks(spark):
    names = [(f"n{k}", [float(k % 3), 1.0, float(k % 5)]) for k in range(12)]
    f = spark.createDataFrame(names + [(None, [1.0, 1.0, 1.0]), ("short", [1.0]), ("zero", [0.0, 0.0, 0.0])], "author string, fingerprint array<double>")
    got = {(r.now, r.was): r.cosine for r in registry.identity_matches(f, f, 0.9, block=4).collect()}
    cos = lambda u, v: sum(x * y for x, y in zip(u, v)) / (sum(x * x for x in u) * sum(y * y for y in v)) ** 0.5
    want = {(a, b): round(cos(u, v), 4) for a, u in names for b, v in names if a != b and round(cos(u, v), 4) >= 0.9}
    assert got == want
