"""Betweenness from lists of neighbours in the shared folder."""

import random

from pyspark.sql import functions as F

from murmuration import catalogue, catalogue_groups
from murmuration.plans import kernels, paths


def graph_of(spark, n=40, seed=3):
    r = random.Random(seed)
    edges = [(f"n{i:02}", f"n{j:02}", round(r.randint(1, 12) / 12, 4)) for i in range(n) for j in range(i + 1, n) if r.random() < (0.9 if j < 30 else 0.1)]
    return spark.createDataFrame([*edges, ("x", "y", 1.0), ("x", "x", 1.0), ("y", "z", None), ("y", "w", 0.0)], "a string, b string, weight double")


def test_lists_give_the_kernel_s_betweenness(spark, monkeypatch):
    df = graph_of(spark)
    real = df.filter("weight > 0 and a <> b")
    nodes = real.selectExpr("a as node").union(real.selectExpr("b")).distinct()
    want = {r.node: r.betweenness for r in kernels.betweenness(real, nodes, None).collect()}
    monkeypatch.setattr(paths, "CELLS", 42 * 5)
    monkeypatch.setattr(paths, "STEPS", 50)
    monkeypatch.setattr(paths, "BUFFER", 64)
    got = {r.node: r.betweenness for r in paths.betweenness(df, nodes.union(spark.createDataFrame([("no",)], "node string"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - x) < 1e-6 for v, x in want.items()) and max(want.values()) > 5
    assert paths.betweenness(df, spark.createDataFrame([("no",)], "node string")).collect() == []


def test_no_query_takes_the_graph_through_the_driver(spark, monkeypatch):
    df = graph_of(spark).filter("weight > 0 and a <> b").withColumn("posts", F.lit(1))
    monkeypatch.setattr(catalogue, "_edges", lambda spark, sf_dir: df)
    monkeypatch.setattr(catalogue_groups.graph, "co_occurrence", lambda *a: df)
    monkeypatch.setattr(catalogue_groups.tables, "events", lambda *a: None)

    def refuse(*a, **b):
        raise AssertionError("not over the driver, nor by joins of all sources with all edges")

    monkeypatch.setattr(kernels, "betweenness", refuse)
    monkeypatch.setattr(catalogue.graph, "betweenness_tables", refuse)
    few, all_ = ({r.node: r.betweenness for r in f(spark, "").collect()} for f in (catalogue.betweenness, catalogue_groups.betweenness_exact))
    assert few == all_ and len(few) == 42
