"""Rows that travel are few and short."""

import numpy as np
from pyspark.sql import functions as F

from murmuration.operators import timing
from murmuration.plans import products


def test_groups_travel_as_bytes_of_gaps():
    rows = [[], [0], [5, 6, 200], [], [127, 128, 300, 2**31 - 1], list(range(0, 90_000, 700)), []]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    ends, flat = products.gap_bytes(starts, np.array([x for r in rows for x in r], np.int32))
    back, numbers = products.from_gap_bytes(ends, flat)
    assert [numbers[i:j].tolist() for i, j in zip(back[:-1], back[1:], strict=True)] == rows
    assert np.diff(ends)[1] == 1 and np.diff(ends)[2] == 4
    empty = products.from_gap_bytes(*products.gap_bytes(np.array([0, 0]), np.array([], np.int32)))
    assert empty[0].tolist() == [0, 0] and not len(empty[1])


def test_packed_members_keep_their_counts(spark):
    rows = [("", 0, k, f"n{k}", None, list(range(k, 400, 40)), [1.0 + (k % 3 == 0)] * len(range(k, 400, 40))) for k in range(12)]
    inc = spark.createDataFrame(rows, "part string, block int, at bigint, node string, tag string, groups array<int>, ns array<double>")
    kept = products._packed(inc).collect()
    assert {r.node for r in kept if r.ns is None} == {f"n{k}" for k in range(12) if k % 3} and all(len(r.groups) < 4 * 10 for r in kept)
    same = inc.union(inc.withColumn("at", F.col("at") + 20).withColumn("node", F.concat(F.lit("x"), "node")))
    got = {(r.a, r.b): r.met for r in products.block_products(same, products.pairs, "a string, b string, met double").collect()}
    assert got == {(f"n{k}", f"xn{k}"): 10 * (1.0 + (k % 3 == 0)) ** 2 for k in range(12)}


def test_cohorts_compare_actors_without_joining_members(spark):
    rows = [(f"p{k % 5}", k, f"a{k * 7 % 13 + k // 40}", 3_600_000_000 * (k // 12 + (k > 60) * 5)) for k in range(120)]
    c = spark.createDataFrame(rows, "url string, pos long, author string, us long")
    bots = spark.createDataFrame([("a1",), ("a1",), ("a5",)], "author string")
    m = timing.cohorts(c, least=3)
    got = {r.cohort: r for r in timing.cohort_shifts(m, bots).collect()}
    of = {}
    for r in m.collect():
        of.setdefault(r.cohort, set()).add(r.author)
    order = sorted(of)
    assert sorted(got) == order[:-1]
    for x, y in zip(order, order[1:], strict=False):
        assert (got[x].next, got[x].size, got[x].next_size, got[x].shared, got[x].bots) == (y, len(of[x]), len(of[y]), len(of[x] & of[y]), round(len(of[x] & {"a1", "a5"}) / len(of[x]), 4))
    plan = timing.cohort_shifts(m, bots)._jdf.queryExecution().optimizedPlan().toString()
    assert "author" not in plan
