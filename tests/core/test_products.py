"""Products of blocks against the joins they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import coordination, figures, graph
from murmuration.plans import products


@pytest.fixture(scope="module")
def comments(spark):
    r = random.Random(5)
    rows = [(f"p{r.randrange(9)}", f"u{r.randrange(40)}", r.randrange(10**6), k, f"text number {r.randrange(4)}") for k in range(700)]
    rows += [("p1", None, 1, 900, "x"), (None, "u1", 1, 901, "x"), ("p2", "?", 1, 902, "x"), ("only", "alone", 1, 903, "x")]
    return spark.createDataFrame(rows, "url string, author string, us bigint, pos bigint, text string").repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(products.incidence, "__defaults__", (7,))
    monkeypatch.setattr(products, "GROUPS", 4)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_blocks_give_the_rows_of_the_joins(spark, comments):
    of = comments.select(F.col("author").alias("node"), F.substring("author", -1, 1).alias("community")).distinct().filter("node is not null")
    for f in (
        lambda dense: coordination.comment_pairs(comments, dense), lambda dense: graph.co_occurrence(comments, None, dense), lambda dense: coordination.inside_degrees(comments, of, dense),
        lambda dense: coordination.tag_links(comments, F.substring("author", -1, 1), dense), lambda dense: coordination.text_likeness(comments, of, 0.4, dense),
    ):
        found = rows(f(True))
        assert found == rows(f(False)) and len(found) > 5


def test_communities_without_edges_take_common_posts(spark, comments):
    of = comments.select(F.col("author").alias("node"), F.substring("author", -1, 1).alias("community")).distinct().filter("node is not null and node <> '?'")
    edges = coordination.comment_pairs(comments, False)
    assert rows(coordination.coordinated_communities(comments, of, None)) == rows(coordination.coordinated_communities(comments, of, edges))


def test_full_tables_are_crowded(spark):
    full = spark.range(4000).crossJoin(spark.range(10).withColumnRenamed("id", "g")).select(F.lit("").alias("part"), F.col("id").cast("string").alias("node"), F.col("g").alias("group"))
    assert products.crowded(full) and not products.crowded(full.filter("group = 0"))


def test_operators_beside_bots(spark, comments):
    few = comments.filter("pos % 3 = 0 or author = 'u7'")
    bots = spark.createDataFrame([(f"u{k}",) for k in range(0, 40, 3)], "author string")
    for posts in (2, 3, 4):
        got = [rows(figures.attributed_operators(few, bots, least_posts=posts, dense=dense)) for dense in (True, False)]
        assert got[0] == got[1] and len(got[0]) > 1
    assert len({r.exclusivity for r in figures.attributed_operators(few, bots, least_posts=4, dense=True).collect()}) > 1


def test_wide_blocks_travel_less(spark, comments, monkeypatch):
    monkeypatch.setattr(products, "BLOCKS", 2)
    monkeypatch.setattr(products, "STRIP", 7)
    n = comments.filter("author is not null and url is not null").groupBy("url", "author").count()
    m = n.select(F.lit("").alias("part"), F.col("author").alias("node"), F.lit(None).cast("string").alias("tag"), F.col("url").alias("group"), F.col("count").alias("n"))
    inc = products.incidence(products.group_numbers(m))
    assert inc.select("block").distinct().count() < -(-inc.count() // 7)
    assert rows(products.block_products(inc, products.pairs, "a string, b string, met double")) == rows(n.withColumnRenamed("author", "a").join(n.select("url", F.col("author").alias("b"), F.col("count").alias("k")), "url").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("count") * F.col("k")).cast("double").alias("met")))
