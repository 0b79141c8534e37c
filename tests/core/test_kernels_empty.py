"""Kernels that find nothing."""

from pyspark.sql import functions as F

from murmuration.operators import campaign
from murmuration.plans.kernels import betweenness, merge_pairs


def test_no_pair_makes_no_team(spark):
    pairs = spark.createDataFrame([("a", "b", 2)], "a string, b string, posts long").groupBy("a", "b").agg(F.sum("posts").alias("posts"))
    none = merge_pairs(pairs.filter("posts > 5"))
    assert none.collect() == [] and none.count() == 0
    profiles = spark.createDataFrame([("a", 1, 1.0, False)], "author string, posts long, mean_place double, is_seed boolean")
    assert campaign.first_movers(profiles, none.count(), 1).collect() == [(0.0,)]
    assert {tuple(r) for r in merge_pairs(pairs).collect()} == {("a", 0), ("b", 0)}


def test_sources_outside_the_graph_add_nothing(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, weight double")
    assert betweenness(edges, spark.createDataFrame([("no",)], "node string")).collect() == []
