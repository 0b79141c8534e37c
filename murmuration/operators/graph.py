"""Graph operators on plain edge tables (a, b, weight) with a < b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from murmuration.operators.actors import known
from murmuration.plans import products
from murmuration.plans.checkpoints import Latest, settle, stored


def co_occurrence(comments: DataFrame, most_actors: int | None = 60, dense: bool | None = None) -> DataFrame:
    """Actors who comment on the same posts: (a, b, posts, weight), weight relative to the strongest edge.

    most_actors takes only the first so many actors of a post by time, a limit that is part of the operator
    (None lifts it): it bounds the edges of one post. Without that limit, edges come from products of blocks where most
    actors meet on many posts (dense; None: as the counts advise).
    """
    if most_actors is not None:
        m = known(comments).groupBy("url", "author").agg(F.min(F.struct(F.coalesce("us", F.lit(0)), "pos")).alias("first"))
        m = m.withColumn("r", F.row_number().over(W.partitionBy("url").orderBy("first", "author"))).filter(F.col("r") <= most_actors)
    else:
        m = stored(known(comments).select("url", "author").distinct())  # the counts, the numbers and the blocks read it
    of = m.select(F.lit("").alias("part"), F.col("author").alias("node"), F.lit(None).cast("string").alias("tag"), F.col("url").alias("group"), F.lit(1).alias("n"))
    if most_actors is None and (products.crowded(of) if dense is None else dense):
        inc = products.incidence(products.group_numbers(of))
        top = products.block_products(inc, products.most, "met double").agg(F.max("met").alias("top"))
        edges = products.block_products(inc, products.pairs, "a string, b string, met double")
        return edges.crossJoin(F.broadcast(top)).select("a", "b", F.col("met").cast("bigint").alias("posts"), F.bround(F.col("met") / F.col("top"), 4).alias("weight"))
    pairs = m.select("url", F.col("author").alias("a")).join(m.select("url", F.col("author").alias("b")), "url").filter("a < b")
    edges = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("posts"))
    top = edges.agg(F.max("posts").alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("a", "b", "posts", F.bround(F.col("posts") / F.col("top"), 4).alias("weight"))


def both_ways(edges: DataFrame, weight: str = "weight") -> DataFrame:
    w = F.col(weight).cast("double").alias("weight")
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), w).union(edges.select("b", "a", w))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.bround(F.sum("weight"), 4).alias("strength"))


def pagerank(edges: DataFrame, steps: int = 20, damping: float = 0.85, weight: str = "weight") -> DataFrame:
    """`steps` power iterations from the uniform vector; edges go both ways, so no node dangles."""
    e = settle(both_ways(edges, weight))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    e = settle(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    nodes = settle(out.select(F.col("src").alias("node")))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(steps):
        flow = e.join(rank, e["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = flow.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("flow")).alias("rank"))
        if k % 5 == 4:
            rank = settle(rank)
    return rank


def member_pagerank(comments: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """`pagerank` of the graph of `co_occurrence` without a limit, weighed by posts, from who was on which post: an actor's flow is what all actors
    of its posts hand out there, less its own. Its edges, which may be as many as pairs of actors, are never made."""
    m = stored(known(comments).filter(F.col("url").isNotNull()).select("url", "author").distinct())
    size = m.groupBy("url").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    m = stored(m.join(size, "url").select("url", F.col("author").alias("node"), "others"))
    rank = stored(m.groupBy("node").agg(F.sum("others").alias("out"), F.count(F.lit(1)).alias("posts")))
    n = rank.count()
    rank, rounds = rank.withColumn("rank", F.lit(1.0 / max(n, 1))), Latest()
    for _ in range(steps):
        held = rank.withColumn("share", F.col("rank") / F.col("out"))
        given = m.join(held.select("node", "share"), "node").groupBy("url").agg(F.sum("share").alias("given"))
        flow = m.select("url", "node").join(given, "url").groupBy("node").agg(F.sum("given").alias("flow"))
        new = F.lit((1 - damping) / max(n, 1)) + damping * (F.col("flow") - F.col("posts") * F.col("share"))
        rank = rounds.put(held.join(flow, "node").select("node", "out", "posts", new.alias("rank")))
    return rank.select("node", "rank")


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: the Gini coefficient of a column of numbers that are not negative."""
    # equal values may take any order: their places are summed by value, so the window runs over distinct values
    v = values.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2
    t = v.select((places * F.col("x")).alias("ix"), (F.col("n") * F.col("x")).alias("sx"), "n").agg(F.sum("ix").alias("ix"), F.sum("sx").alias("sx"), F.sum("n").alias("n"))
    g = F.when((F.col("n") > 0) & (F.col("sx") > 0), 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return t.select(F.bround(g, 4).alias("gini"), "n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that paths reach. Every round hangs a node's larger neighbours on the least node
    around it, then all its smaller ones and itself on the least of these, until every component is a star: rounds grow with the
    logarithm of the longest path. Rounds are written as tables: checkpoints hand on what the optimizer knows of their
    rows, which grows by every round's joins and fills the driver. Edges with a null end are left out."""
    a, b = F.col("a"), F.col("b")
    real = edges.select("a", "b").filter(a.isNotNull() & b.isNotNull())
    ends, stars = Latest(), Latest()
    e = first = stored(real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = e.filter("u <> v")
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = mark(e)
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = ends.put(e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stars.put(small.union(least.select("u", "m")).distinct())
        before, state = state, mark(e)
        if state == before:
            found = e.union(e.select("v", "v")).union(first.filter("u = v"))
            return found.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    raise RuntimeError("components did not settle")


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): a fixed number of rounds in which every node takes the label of most weight around it and on
    itself, ties to the least. Deterministic, other than randomised methods; compare partitions, not labels."""
    e = settle(both_ways(edges))
    label = e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = e.join(label, e["dst"] == label["node"]).select(F.col("src").alias("node"), "community", "weight")
        own = label.select("node", "community", F.lit(1e-6).alias("weight"))
        sums = votes.union(own).groupBy("node", "community").agg(F.bround(F.sum("weight"), 6).alias("w"))
        best = F.row_number().over(W.partitionBy("node").orderBy(F.desc("w"), "community"))
        label = settle(sums.withColumn("r", best).filter("r = 1").select("node", "community"))
    return label


def betweenness_tables(edges: DataFrame, sources: DataFrame, batch: int = 256, tolerance: float = 1e-9) -> DataFrame:
    """(node, betweenness) by weighted shortest paths from the given sources (node), with no graph in any one task: distances
    are 1 / weight, paths of equal length within the tolerance share.

    Sources go in batches, which bounds what is held to batch * nodes rows. In rounds over the partitioned edges, distances
    spread from the nodes that the last round brought nearer; then numbers of paths flow along the edges of
    shortest paths, and shares flow back. Every round reaches one edge further, so rounds are as many as the edges
    of the longest of the shortest paths. A source's own paths end at it without counting for it; edges whose weight is null
    or not above 0 are left out. Sources that the graph doesn't hold add nothing, nodes that no path crosses get 0.
    """
    real = edges.filter((F.col("weight") > 0) & (F.col("a") != F.col("b")))
    e = stored(both_ways(real).groupBy("src", "dst").agg((1 / F.max("weight")).alias("length")))
    nodes = e.select(F.col("src").alias("node")).distinct()
    order = W.orderBy("node")  # one column of the sources
    asked = stored(sources.select("node").distinct().join(nodes, "node", "left_semi").withColumn("turn", F.floor((F.row_number().over(order) - 1) / batch)))
    turns = (asked.agg(F.max("turn")).first()[0] or 0) + 1
    parts = []
    for turn in range(turns):
        near = fresh = stored(asked.filter(F.col("turn") == turn).select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d")))
        while True:
            step = fresh.join(e, F.col("node") == F.col("src")).groupBy("s", "dst").agg(F.min(F.col("d") + F.col("length")).alias("to"))
            step = step.join(near.select("s", F.col("node").alias("dst"), "d"), ["s", "dst"], "left").filter(F.col("d").isNull() | (F.col("to") < F.col("d") - tolerance))
            fresh = stored(step.select("s", F.col("dst").alias("node"), F.col("to").alias("d")))
            if fresh.isEmpty():
                break
            near = stored(near.union(fresh).groupBy("s", "node").agg(F.min("d").alias("d")))
        on = near.join(e, F.col("node") == F.col("src")).join(near.select("s", F.col("node").alias("dst"), F.col("d").alias("there")), ["s", "dst"])
        on = stored(on.filter(F.abs(F.col("d") + F.col("length") - F.col("there")) <= tolerance).select("s", F.col("src").alias("u"), F.col("dst").alias("v")))
        first = near.filter(F.col("node") == F.col("s")).select("s", "node", F.lit(1.0).alias("paths"))
        paths = _flow(first, lambda held: on.join(held.withColumnRenamed("node", "u"), ["s", "u"]).groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths")), "paths")  # noqa: B023
        ends = lambda c: paths.select("s", F.col("node").alias(c), F.col("paths").alias(f"p{c}"))  # noqa: B023, E731
        share = stored(on.join(ends("u"), ["s", "u"]).join(ends("v"), ["s", "v"]).select("s", "u", "v", (F.col("pu") / F.col("pv")).alias("part")))
        back = lambda held: share.join(held.withColumnRenamed("node", "v"), ["s", "v"], "left").groupBy("s", F.col("u").alias("node")).agg(F.sum(F.col("part") * (1 + F.coalesce("share", F.lit(0.0)))).alias("share"))  # noqa: B023, E731
        none = near.select("s", "node", F.lit(0.0).alias("share")).limit(0)
        parts.append(_flow(none, back, "share").filter(F.col("node") != F.col("s")).groupBy("node").agg(F.sum("share").alias("part")))
    parts = [stored(p) for p in parts]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    total = total.groupBy("node").agg((F.sum("part") / 2).alias("betweenness"))
    return nodes.join(total, "node", "left").fillna(0.0, ["betweenness"])


def _flow(start: DataFrame, step, value: str) -> DataFrame:
    """start and all that repeated steps of it reach, until a step changes nothing: what flows in an acyclic graph. A node that
    start holds keeps its value."""
    held = start
    fixed = start.select("s", "node").withColumn("fixed", F.lit(True))
    while True:
        new = step(held).join(fixed, ["s", "node"], "left").filter(F.col("fixed").isNull()).select("s", "node", value).union(start)
        new = stored(new)
        was = held.select("s", "node", F.col(value).alias("was"))
        changed = new.join(was, ["s", "node"], "left").filter(F.col("was").isNull() | (F.abs(F.col(value) - F.col("was")) > 1e-9 * F.abs(F.col(value)))).limit(1)
        if changed.isEmpty():
            return new
        held = new


def heavy_components(edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Components of the heaviest share of the edges."""
    cut = edges.agg(F.percentile("weight", F.lit(1 - share)).alias("cut"))
    return components(edges.crossJoin(F.broadcast(cut)).filter(F.col("weight") >= F.col("cut")))


def cluster_density(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, nodes, edges, density) of the subgraphs that the communities induce."""
    m = membership.select("node", "community")
    inside = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
    k = inside.groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("edges"))
    n = m.groupBy("community").agg(F.count(F.lit(1)).alias("nodes")).join(k, "community", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return n.withColumn("density", F.bround(F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 4))


def roles(nodes: DataFrame) -> DataFrame:
    """nodes (node, degree, betweenness, suspect): role by ratios to the largest values."""
    top = nodes.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most_degree"), F.greatest(F.max("betweenness"), F.lit(1e-9)).alias("most_betweenness"))
    d, b = F.col("degree") / F.col("most_degree"), F.col("betweenness") / F.col("most_betweenness")
    role = F.when((d >= 0.5) & (b >= 0.3), "COMMAND").when((d >= 0.3) & F.col("suspect"), "AMPLIFIER").when(F.col("suspect") & (F.col("degree") >= 2), "BOT_CLUSTER").when(d >= 0.5, "HUB").otherwise("PERIPHERAL")
    return nodes.crossJoin(F.broadcast(top)).withColumn("role", role).drop(*top.columns)  # top is one row


def influence(nodes: DataFrame) -> DataFrame:
    """nodes (node, rank, betweenness, degree, suspect_score): 0 to 100."""
    top = nodes.agg(*[F.greatest(F.max(c), F.lit(1e-12)).alias(f"most_{c}") for c in ("rank", "betweenness", "degree")])
    part = lambda c: F.col(c) / F.col(f"most_{c}")
    score = 50 * part("rank") + 30 * part("betweenness") + 20 * part("degree") + 0.2 * F.coalesce("suspect_score", F.lit(0.0))
    return nodes.crossJoin(F.broadcast(top)).withColumn("influence", F.bround(F.least(F.lit(100.0), score), 2)).drop(*top.columns)  # top is one row


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the weighted modularity of a partition."""
    m = membership.select("node", "community")
    total = edges.agg(F.sum("weight").alias("total"))
    inside = edges.join(m.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    strength = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("s")).join(m, "node").groupBy("community").agg(F.sum("s").alias("s"))
    square = strength.agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    return total.crossJoin(inside).crossJoin(square).select(F.bround(F.col("inside") / F.col("total") - F.col("square") / (4 * F.col("total") * F.col("total")), 4).alias("modularity"))
