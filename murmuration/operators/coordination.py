"""Coordinated groups: communities of a co-comment graph with their synchrony, likeness, risk and controller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.operators.actors import known
from murmuration.operators.graph import components
from murmuration.plans import products
from murmuration.plans.checkpoints import settle, stored


def _members(rows: DataFrame, part: Column | None = None, tag: Column | None = None, n: Column | None = None, group: str = "url") -> DataFrame:
    """Actors as the members of their groups."""
    none = F.lit(None).cast("string")
    return rows.select((F.lit("") if part is None else part.cast("string")).alias("part"), F.col("author").alias("node"), (none if tag is None else tag).alias("tag"), F.col(group).alias("group"), (F.lit(1) if n is None else n).alias("n"))


def comment_pairs(comments: DataFrame, dense: bool | None = None) -> DataFrame:
    """(a, b, weight): pairs of comments, not of different actors, on the same post; a = b where an actor comments again.

    A post's actors are counted first and pairs come from the counts, so a busy post costs its actors' pairs only. Where most
    actors meet on many posts, the pairs come from products of blocks instead (dense; None: as the counts advise).
    """
    n = stored(known(comments).groupBy("url", "author").agg(F.count(F.lit(1)).alias("n")))
    m = _members(n, n=F.col("n"))
    if products.crowded(m) if dense is None else dense:
        met = products.block_products(products.incidence(products.group_numbers(m)), products.pairs, "a string, b string, met double")
        others = met.select("a", "b", F.col("met").alias("weight"))
    else:
        x, y = n.select("url", F.col("author").alias("a"), F.col("n").alias("na")), n.select("url", F.col("author").alias("b"), F.col("n").alias("nb"))
        others = x.join(y, "url").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("weight"))
    own = n.groupBy(F.col("author").alias("a"), F.col("author").alias("b")).agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("weight")).filter("weight > 0")
    return others.union(own)


def tag_links(comments: DataFrame, tag: Column, dense: bool | None = None) -> DataFrame:
    """(tag_a, tag_b, links): pairs of actors a < b with a post in common, counted by a tag of both; tag is a function of the author."""
    m = _members(stored(known(comments).select("url", "author").distinct()), tag=tag)
    if products.crowded(m) if dense is None else dense:
        links = products.block_products(products.incidence(products.group_numbers(m)), products.tagged, "tag_a string, tag_b string, links bigint")
        return links.groupBy("tag_a", "tag_b").agg(F.sum("links").alias("links"))
    end = lambda x: m.select("group", F.col("node").alias(x), F.col("tag").alias(f"tag_{x}"))
    met = end("a").join(end("b"), "group").filter("a < b").groupBy("a", "b").agg(F.any_value("tag_a").alias("tag_a"), F.any_value("tag_b").alias("tag_b"))
    return met.groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("links"))


def inside_degrees(comments: DataFrame, membership: DataFrame, dense: bool | None = None) -> DataFrame:
    """(community, node, degree): with how many others of its community an actor has a post in common; those without any are left out."""
    of = membership.select(F.col("node").alias("author"), "community")
    m = _members(stored(known(comments).select("url", "author").distinct().join(of, "author")), part=F.col("community"))
    if products.crowded(m) if dense is None else dense:
        k = products.block_products(products.incidence(products.group_numbers(m)), products.degrees, "part string, node string, degree bigint")
    else:
        met = m.select("part", "group", F.col("node").alias("a")).join(m.select("part", "group", F.col("node").alias("b")), ["part", "group"]).filter("a < b").select("part", "a", "b").distinct()
        k = met.select("part", F.col("a").alias("node"), F.lit(1).alias("degree")).union(met.select("part", "b", F.lit(1)))
    k = k.groupBy(F.col("part").cast(membership.schema["community"].dataType).alias("community"), "node").agg(F.sum("degree").alias("degree"))
    return k.select("community", "node", "degree")


def threshold_communities(edges: DataFrame, nodes: DataFrame, least_size: int = 3, bar: float = 0.3) -> DataFrame:
    """(node, community) without a graph library: components of the edges above the bar, but components of all edges that
    are smaller than `least_size` stay whole whatever their weights. nodes (node) without edges stand alone."""
    real = edges.filter(F.col("a") != F.col("b"))
    whole = settle(nodes.join(components(real), "node", "left").select("node", F.coalesce("component", "node").alias("whole")))
    size = whole.groupBy("whole").agg(F.count(F.lit(1)).alias("size"))
    fine = components(real.filter(F.col("weight") > bar))
    j = whole.join(size, "whole").join(fine, "node", "left")
    return j.select("node", F.when(F.col("size") < least_size, F.col("whole")).otherwise(F.coalesce("component", "node")).alias("community"))


def text_likeness(comments: DataFrame, membership: DataFrame, bar: float = 0.40, dense: bool | None = None) -> DataFrame:
    """(community, likeness): the share of actor pairs whose sets of texts (lower case, over five characters) have a Jaccard
    above the bar. Only pairs with a text in common are built; all others are counted. Where most actors have texts in common, the
    pairs are counted in products of blocks (dense)."""
    t = known(comments).withColumn("t", F.lower(F.trim("text"))).filter(F.char_length("t") > 5)
    t = t.join(membership.withColumnRenamed("node", "author"), "author").select("community", "author", "t").distinct()
    size = t.groupBy("community", "author").agg(F.count(F.lit(1)).alias("size"))
    all_ = size.groupBy("community").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs"))
    m = _members(t, part=F.col("community"), group="t")
    if products.crowded(m) if dense is None else dense:
        like = products.block_products(products.incidence(products.group_numbers(m)), products.alike(bar), "part string, like bigint")
        like = like.groupBy(F.col("part").cast(t.schema["community"].dataType).alias("community")).agg(F.sum("like").alias("like"))
        return _share_alike(all_, like)
    x, y = t.select("community", "t", F.col("author").alias("a")), t.select("community", "t", F.col("author").alias("b"))
    both = x.join(y, ["community", "t"]).filter("a < b").groupBy("community", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = both.join(size.select("community", F.col("author").alias("a"), F.col("size").alias("na")), ["community", "a"]).join(size.select("community", F.col("author").alias("b"), F.col("size").alias("nb")), ["community", "b"])
    like = both.filter(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) > bar).groupBy("community").agg(F.count(F.lit(1)).alias("like"))
    return _share_alike(all_, like)


def _share_alike(all_: DataFrame, like: DataFrame) -> DataFrame:
    return all_.join(like, "community", "left").select("community", F.when(F.col("pairs") > 0, F.coalesce("like", F.lit(0)) / F.col("pairs")).otherwise(0.0).alias("likeness"))


def synchrony(comments: DataFrame, membership: DataFrame, within_us: int = 3_000_000) -> DataFrame:
    """(community, sync): of all pairs of timed comments by a community's actors on one post, the share no more than
    `within_us` apart. Pairs are counted by a range window over the comments of a post, not built."""
    from pyspark.sql import Window as W

    t = known(comments).filter(F.col("us").isNotNull()).join(membership.withColumnRenamed("node", "author"), "author").select("community", "url", "us", "pos")
    by = W.partitionBy("community", "url").orderBy("us")
    at = t.select("community", "url", "us", F.count(F.lit(1)).over(by.rangeBetween(-within_us, 0)).alias("upto"), F.count(F.lit(1)).over(W.partitionBy("community", "url", "us")).alias("ties"))
    # of m comments at one instant with k at or before it in reach: m * (k - m) + m * (m - 1) / 2 pairs, dealt to the m rows
    per = at.groupBy("community", "url").agg(F.sum((F.col("upto") - F.col("ties")) + (F.col("ties") - 1) / 2).alias("near"), (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs"))
    return per.groupBy("community").agg((F.sum("near") / F.greatest(F.sum("pairs"), F.lit(1.0))).alias("sync"))


def coordinated_communities(comments: DataFrame, membership: DataFrame, edges: DataFrame | None, within_us: int = 3_000_000, like: float = 0.40) -> DataFrame:
    """Per community: size, density, synchrony, likeness, controller (most neighbours inside, ties to the least name), its
    confidence, the score 30 * density + 40 * synchrony + 30 * likeness, and whether that exceeds 40. Without edges,
    actors with a post in common are neighbours; these are counted, not built."""
    m = membership.select("node", "community")
    if edges is None:
        deg = stored(inside_degrees(comments, m))
    else:
        real = edges.filter(F.col("a") != F.col("b")).select("a", "b")
        inside = real.join(m.select(F.col("node").alias("a"), "community"), "a").join(m.select(F.col("node").alias("b"), F.col("community").alias("other")), "b").filter("community = other")
        inside = settle(inside.select("community", "a", "b").distinct())
        deg = inside.select("community", F.col("a").alias("node")).union(inside.select("community", "b")).groupBy("community", "node").agg(F.count(F.lit(1)).alias("degree"))
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    links = deg.groupBy("community").agg((F.sum("degree") / 2).alias("links"))
    deg = m.join(deg, ["community", "node"], "left").fillna(0, ["degree"])
    top = deg.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("top"))
    j = size.join(links, "community", "left").join(top, "community").join(synchrony(comments, m, within_us), "community", "left").join(text_likeness(comments, m, like), "community", "left")
    n, e = F.col("size"), F.coalesce("links", F.lit(0))
    density = F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0)
    alone = n < 2
    sync, likeness = (F.when(alone, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("sync", "likeness"))
    score = F.least(F.lit(100.0), 30 * density + 40 * sync + 30 * likeness)
    return j.select("community", "size", F.bround(density, 4).alias("density"), F.bround(sync, 4).alias("sync"), F.bround(likeness, 4).alias("likeness"), F.col("top.node").alias("controller"), F.bround(-F.col("top.d") / n, 4).alias("controller_confidence"), F.bround(score, 1).alias("score"), (score > 40).alias("coordinated"))


def cluster_risk(nodes: DataFrame) -> DataFrame:
    """nodes (node, community, degree, suspect_score, attacks): communities of two actors and more with their mean suspect
    score, attacks, leading actor and risk. `edge_density` is that mean by 100: the name is kept, it is no density."""
    g = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node"))["node"].alias("top_actor"), F.avg("suspect_score").alias("mean"), F.sum("attacks").alias("attacks")).filter("size >= 2")
    m, k = F.col("mean"), F.col("attacks")
    risk = F.when((m >= 70) | (k >= 20), "CRITICAL").when((m >= 40) | (k >= 10), "HIGH").when((m >= 20) | (k >= 5), "MEDIUM").otherwise("LOW")
    return g.select("community", "size", "top_actor", "attacks", F.bround("mean", 1).alias("coord_score"), F.bround(F.least(F.lit(1.0), m / 100), 3).alias("edge_density"), risk.alias("risk"))


def graph_coordination(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, community, suspect), edges (kind; n, if rows stand for several): one row, 0 to 99: 40 for the share of
    suspects, 30 for that of edges from common posts, 30 for the largest community of two and more."""
    n = F.col("n") if "n" in edges.columns else F.lit(1).cast("bigint")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    largest = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("suspect").alias("suspects")).crossJoin(edges.agg(count(n).alias("edges"), count(F.when(F.col("kind") == "co_comment", n)).alias("common"))).crossJoin(largest)  # one row each
    score = 40 * F.col("suspects") / F.col("nodes") + 30 * F.col("common") / F.col("edges") + 30 * F.col("largest") / F.col("nodes")
    return a.withColumn("coordination", F.when((F.col("nodes") > 0) & (F.col("edges") > 0), F.least(F.lit(99), F.floor(score))).otherwise(0).cast("int"))


def plain_metrics(edges: DataFrame) -> DataFrame:
    """Node metrics without a graph library: degree by the largest stands for centrality and betweenness."""
    d = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    deg = d.select(F.col("a").alias("node")).union(d.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return deg.crossJoin(F.broadcast(deg.agg(F.max("degree").alias("top")))).select("node", "degree", F.bround(F.col("degree") / F.col("top"), 4).alias("centrality"), F.bround(F.col("degree") / F.col("top"), 4).alias("betweenness"))  # one row


def common_bots(bots: DataFrame, clusters: DataFrame, most: int = 20) -> DataFrame:
    """bots (page, author), clusters (page, cluster): the actors on all pages of a cluster, or, where there are none, up to
    `most` of those on any, by name; `everywhere` tells which."""
    pages = clusters.groupBy("cluster").agg(F.count_distinct("page").alias("pages"))
    on = bots.join(clusters, "page").groupBy("cluster", "author").agg(F.count_distinct("page").alias("k")).join(pages, "cluster")
    g = on.groupBy("cluster").agg(F.array_sort(F.collect_list(F.when(F.col("k") == F.col("pages"), F.col("author")))).alias("all"), F.slice(F.array_sort(F.collect_set("author")), 1, most).alias("some"))
    return g.select("cluster", (F.size("all") > 0).alias("everywhere"), F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("some")).alias("actors"))


def paired_accounts(posts: DataFrame, least: float = 0.45, words: Column | None = None) -> DataFrame:
    """posts (page, url, text): pairs of pages that share an address and whose words (four letters and more) have a Jaccard
    of at least `least`; the words of all a page's posts are one set."""
    ws = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0)) if words is None else words
    at = posts.select("page", "url").distinct()
    met = at.select("url", F.col("page").alias("a")).join(at.select("url", F.col("page").alias("b")), "url").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("urls"))
    bag = posts.select("page", F.explode(ws).alias("w")).distinct()
    size = bag.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    x = met.join(bag.select(F.col("page").alias("a"), "w"), "a")
    shared = x.join(bag.select(F.col("page").alias("b"), "w"), ["b", "w"]).groupBy("a", "b", "urls").agg(F.count(F.lit(1)).alias("shared"))
    j = shared.join(size.select(F.col("page").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("page").alias("b"), F.col("n").alias("nb")), "b")
    return j.withColumn("jaccard", F.bround(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4)).filter(F.col("jaccard") >= least).select("a", "b", "urls", "shared", "jaccard")
