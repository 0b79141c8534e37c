"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmuration.llm import scratch


def connected_components(edges: DataFrame, a: str, b: str, most_edges: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge to another, but the roots themselves; root is the least node
    of its component. most_edges, where it is known, sizes the files.

    Each round replaces the edges by stars around smaller nodes, with joins and minima only, so a hub
    with millions of neighbours is never collected. Edges with a null end and loops are ignored.
    Rounds grow with the logarithm of the longest path; the state of each is a table in the shared folder.
    """
    x, y = F.col(a), F.col(b)
    e = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = scratch.materialize(e, "edges", most_edges)
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    state = mark(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.union(e.select("v", "u"))
        # minima are written first: a join right above two exchanges is split where a hub is hot
        least = scratch.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * state[0])
        large = scratch.materialize(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", state[0])
        least = scratch.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", state[0])
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.materialize(small.union(least.select("u", "m")).distinct(), "edges", 2 * state[0])
        before, state = state, mark(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
