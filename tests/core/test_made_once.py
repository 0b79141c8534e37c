"""Rows that counts, numbers and blocks all read are made once."""

import pytest
from pyspark.sql import functions as F

from murmuration import catalogue_groups
from murmuration.operators import coordination, figures, graph, groups
from murmuration.plans import products


@pytest.fixture
def comments(spark):
    rows = [(f"p{k % 5}", k, f"a{k * 7 % 11}", "", k, 0, "s", "comment") for k in range(120)]
    return spark.createDataFrame(rows, "url string, pos long, author string, text string, us long, likes int, source string, action string")


def test_members_of_products_come_from_a_table(spark, comments, monkeypatch):
    seen = []
    monkeypatch.setattr(products, "crowded", lambda left, right=None: seen.extend(x for x in (left, right) if x is not None) or False)
    bots = spark.createDataFrame([("a1",), ("a2",)], "author string")
    of = comments.select(F.col("author").alias("node"), F.lit("c").alias("community")).distinct()
    for f in (
        lambda: coordination.comment_pairs(comments), lambda: graph.co_occurrence(comments, None), lambda: coordination.tag_links(comments, F.substring("author", -1, 1)),
        lambda: coordination.inside_degrees(comments, of), lambda: figures.attributed_operators(comments, bots),
    ):
        seen.clear()
        f().count()
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
        assert plans and all("Aggregate" not in p and "Join" not in p and df.inputFiles() for p, df in zip(plans, seen, strict=True))


def test_narratives_are_compared_once_for_their_score(spark, tmp_path, monkeypatch):
    texts = [(k, f"lang genug der text nummer {k // 3} und noch mehr worte davon", "de", f"s{k % 4}", 60) for k in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    calls, real = [], groups.narrative_groups
    monkeypatch.setattr(groups, "narrative_groups", lambda *a, **b: calls.append(1) or real(*a, **b))
    (r,) = catalogue_groups.seeding_campaign(spark, str(tmp_path)).collect()
    assert len(calls) == 1 and r.seeds > 0
    c = catalogue_groups._paged(spark, str(tmp_path))
    assert tuple(r) == tuple(groups.seeding_score(groups.narrative_seeds(c), groups.narrative_groups(c)).first())
