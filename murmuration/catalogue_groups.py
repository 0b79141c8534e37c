"""Queries of groups that a loop in order would form, and SQL that runs that loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.catalogue import ORACLES, query, suspect_scores
from murmuration.operators import actors, communities, coordination, graph, groups
from murmuration.plans import paths
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables

#: Documents with the words of their normalised text, and pairs of documents with the Jaccard of their n-grams.
WORDS = r"""w AS (SELECT doc_id, source || '/' || lang AS author, source, doc_id::VARCHAR AS url, coalesce(text, '') AS text, doc_id * 10000000 AS us,
  list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: len(x) > 0) AS ws FROM documents)"""
GRAMS3 = "h AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] ELSE ws END) AS t FROM w)"
GRAMS2 = "h AS (SELECT id, list_distinct(CASE WHEN len(ws) >= 2 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] ELSE ws END) AS t FROM v)"
LIKE = """f AS (SELECT id, unnest(t) AS g, len(t) AS n FROM h), j AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS shared, round_even(count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE, 4) AS jaccard
  FROM f x JOIN f y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE >= {bar})"""
#: The loop over pairs pr (a, b): rows of which some earlier like row leads don't; `never` (node) can't.
LOOP = """n AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT a AS node FROM pr UNION SELECT b FROM pr)),
k AS MATERIALIZED (SELECT y.i, list(x.i) AS before FROM pr JOIN n x ON x.node = pr.a JOIN n y ON y.node = pr.b GROUP BY y.i),
r(i, leads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN len(list_intersect(coalesce(k.before, []), r.leads)) = 0 AND n.node NOT IN (SELECT node FROM never) THEN list_append(r.leads, n.i) ELSE r.leads END
  FROM r JOIN n ON n.i = r.i + 1 LEFT JOIN k ON k.i = n.i),
l AS MATERIALIZED (SELECT unnest(leads) AS i FROM r WHERE i = (SELECT max(i) FROM r)),
m AS MATERIALIZED (SELECT pr.b AS node, min(pr.a) AS leader FROM pr JOIN n ON n.node = pr.a JOIN l ON l.i = n.i GROUP BY 1),
g AS (SELECT * FROM m UNION SELECT leader, leader FROM m)"""
NEVER = "never AS (SELECT NULL::BIGINT AS node WHERE false)"


def _documents(spark, sf_dir):
    """Documents as comments, one on each post, every ten seconds in order of their id."""
    return tables.documents(spark, sf_dir).withColumn("id", F.col("pos")).withColumn("us", F.col("pos") * 10_000_000)


@query("copycat_groups", "WITH RECURSIVE " + WORDS + ", " + GRAMS3 + ", " + LIKE.format(bar=0.65) + """, c AS (SELECT * FROM w WHERE length(trim(text)) >= 3 AND author IS NOT NULL),
pr AS MATERIALIZED (SELECT a, b, jaccard FROM j JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE x.author <> y.author),
n AS MATERIALIZED (SELECT node, author, url, len(t) >= 2 AS able, row_number() OVER (ORDER BY node) AS i FROM (SELECT a AS node FROM pr UNION SELECT b FROM pr) JOIN c ON doc_id = node JOIN h ON id = node),
k AS MATERIALIZED (SELECT x.i, list(y.i) AS around FROM (SELECT a, b FROM pr UNION SELECT b, a FROM pr) d JOIN n x ON x.node = d.a JOIN n y ON y.node = d.b GROUP BY 1),
z AS MATERIALIZED (SELECT list(author ORDER BY i) AS authors, list(url ORDER BY i) AS urls FROM n),
s(i, taken, of, group_) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT i, CASE WHEN fits THEN list_concat(taken, found) ELSE taken END, CASE WHEN fits THEN i END, CASE WHEN fits THEN found ELSE [] END FROM (
    SELECT *, able AND NOT list_contains(taken, i) AND len(found) >= 2 AND len(who) <= 15 AND (len(spots) >= 2 OR len(who) >= 3) AS fits FROM (
      SELECT *, list_distinct([authors[x] FOR x IN found]) AS who, list_distinct([urls[x] FOR x IN found]) AS spots FROM (
        SELECT n.i, n.able, s.taken, list_append(list_filter(k.around, lambda x: NOT list_contains(s.taken, x)), n.i) AS found, z.* FROM s JOIN n ON n.i = s.i + 1 JOIN k ON k.i = n.i, z)))),
o AS (SELECT of, unnest(group_) AS i FROM s WHERE of IS NOT NULL)
SELECT x.node AS leader, y.node AS id, CASE WHEN x.node = y.node THEN 1.0::DOUBLE ELSE p.jaccard END AS similarity FROM o JOIN n x ON x.i = o.of JOIN n y ON y.i = o.i LEFT JOIN pr p ON p.a = least(x.node, y.node) AND p.b = greatest(x.node, y.node)""")
def copycat_groups(spark, sf_dir):
    return groups.copycats(_documents(spark, sf_dir))


@query("cib_clusters", "WITH RECURSIVE " + WORDS + ", " + GRAMS3 + ", " + LIKE.format(bar=0.45) + """, pr AS MATERIALIZED (SELECT a, b, jaccard FROM j JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b WHERE x.source <> y.source AND abs(x.us - y.us) <= 7200000000),
never AS (SELECT doc_id AS node FROM w WHERE length(trim(text)) < 40), """ + LOOP + """
SELECT g.leader, g.node AS id, CASE WHEN g.leader = g.node THEN 1.0::DOUBLE ELSE pr.jaccard END AS similarity FROM g LEFT JOIN pr ON pr.a = g.leader AND pr.b = g.node""")
def cib_clusters(spark, sf_dir):
    return groups.cib_clusters(_documents(spark, sf_dir))


NARRATIVES = "WITH RECURSIVE " + r"""s AS (SELECT doc_id AS id, source || '/' || lang AS author, source AS url, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE length(text) >= 15),
u AS MATERIALIZED (SELECT min(id) AS id, author, url, arg_min(t, id) AS t FROM s GROUP BY author, url, substring(t, 1, 60)), v AS (SELECT id, list_filter(string_split(t, ' '), lambda x: len(x) > 0) AS ws FROM u), """ + GRAMS2 + ", " + LIKE.format(bar=0.5) + f", pr AS MATERIALIZED (SELECT a, b FROM j), {NEVER}, " + LOOP + ", q AS (SELECT coalesce(g.leader, u.id) AS leader, u.id, url, author FROM u LEFT JOIN g ON g.node = u.id)"


def _paged(spark, sf_dir):
    """Documents as comments on their source's page."""
    return _documents(spark, sf_dir).withColumn("url", F.col("source"))


@query("narrative_groups", NARRATIVES + " SELECT * FROM q")
def narrative_groups(spark, sf_dir):
    return groups.narrative_groups(_paged(spark, sf_dir))


@query("narrative_seeds", NARRATIVES + """ SELECT leader, arg_min(url, id) AS first_url, arg_min(author, id) AS first_author, min(id * 10000000) AS first_us, count(DISTINCT url) AS posts, count(DISTINCT author) AS actors, count(*) AS size, count(DISTINCT url) - 1 AS spread
FROM q GROUP BY leader HAVING count(DISTINCT url) >= 2""")
def narrative_seeds(spark, sf_dir):
    return groups.narrative_seeds(_paged(spark, sf_dir))


@query("seeding_campaign", NARRATIVES + """, e AS (SELECT leader FROM q GROUP BY leader HAVING count(DISTINCT url) >= 2), a AS (SELECT count(*) AS k FROM (SELECT author FROM q JOIN e USING (leader) GROUP BY author HAVING count(DISTINCT url) >= 3)), z AS (SELECT count(*) AS seeds FROM e)
SELECT seeds, least(k, 15) AS actors, round_even(least(50.0::DOUBLE, 8.0 * seeds) + least(50.0::DOUBLE, 10.0 * least(k, 15)), 1) AS score FROM z, a""")
def seeding_campaign(spark, sf_dir):
    c = _paged(spark, sf_dir)
    members = stored(groups.narrative_groups(c))  # the texts are compared once
    return groups.seeding_score(stored(groups.narrative_seeds(c, members=members)), members)


def _style(spark, sf_dir):
    """Speakers of conversations with their text habits."""
    c = tables.conversations(spark, sf_dir).withColumn("author", F.concat_ws("/", "url", "author"))
    return actors.style_features(c)


@query("style_groups")
def style_groups(spark, sf_dir):
    return groups.style_groups(_style(spark, sf_dir), actors.STYLE, 0.99999)


@query("page_groups", "WITH RECURSIVE " + r"""d AS (SELECT source AS page, lang AS url, lower(coalesce(text, '')) AS text FROM documents), b AS (SELECT DISTINCT page, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS w FROM d), z AS (SELECT page, count(*) AS n FROM b GROUP BY 1),
x2 AS (SELECT x.page AS a, y.page AS b, count(*) AS shared FROM b x JOIN b y ON x.w = y.w AND x.page < y.page GROUP BY 1, 2), u AS (SELECT DISTINCT page, url FROM d),
pr AS MATERIALIZED (SELECT a, b FROM x2 JOIN z za ON za.page = a JOIN z zb ON zb.page = b WHERE round_even(shared / (za.n + zb.n - shared)::DOUBLE, 4) >= 0.12 AND EXISTS (SELECT 1 FROM u p JOIN u q ON p.url = q.url WHERE p.page = a AND q.page = b)),
never AS (SELECT NULL::VARCHAR AS node WHERE false), """ + LOOP + " SELECT * FROM g")
def page_groups(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups.page_groups(coordination.paired_accounts(d.select(F.col("source").alias("page"), F.col("lang").alias("url"), "text"), 0.12))


# SQL of earlier queries of like documents
ORACLES["near_dup_documents"] = "WITH " + WORDS + ", " + GRAMS3 + ", " + LIKE.format(bar=0.65) + " SELECT * FROM j"
ORACLES["bigram_jaccard"] = "WITH " + WORDS + ", v AS (SELECT doc_id AS id, ws FROM w), " + GRAMS2 + ", " + LIKE.format(bar=0.5) + " SELECT a::VARCHAR AS a, b::VARCHAR AS b, shared, jaccard FROM (SELECT least(a::VARCHAR, b::VARCHAR) AS a, greatest(a::VARCHAR, b::VARCHAR) AS b, shared, jaccard FROM j)"


# --- communities of highest modularity


def _pairs(spark, sf_dir):
    return stored(communities.normalised(coordination.comment_pairs(tables.events(spark, sf_dir))))


@query("modular_communities")
def modular_communities(spark, sf_dir):
    return communities.modular_communities(_pairs(spark, sf_dir))


@query("psi_coordination")
def psi_coordination(spark, sf_dir):
    """Communities of the co-comment graph with their density, synchrony within three seconds, likeness and controller."""
    pairs = _pairs(spark, sf_dir)
    return coordination.coordinated_communities(tables.events(spark, sf_dir), communities.modular_communities(pairs), pairs)


@query("psi_network")
def psi_network(spark, sf_dir):
    """One row on all communities; the slices in which actors recur are event types, each with communities of its own."""
    c, pairs = tables.events(spark, sf_dir), _pairs(spark, sf_dir)
    clusters = coordination.coordinated_communities(c, communities.modular_communities(pairs), pairs)
    of = coordination.comment_pairs(c.withColumn("author", F.concat_ws("|", "source", "author")))
    sliced = communities.modular_communities(of).select(F.substring_index("node", "|", 1).alias("slice"), F.substring_index("node", "|", -1).alias("author"), "community")
    scores = suspect_scores(spark, sf_dir).select("author", F.col("suspect_score").alias("score"))
    return communities.network_summary(clusters, scores, sliced)


@query("community_risk")
def community_risk(spark, sf_dir):
    """Risk of the communities of highest modularity by their actors' suspect scores and attacks."""
    c = tables.events(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    n = c.groupBy(F.col("author").alias("node")).agg(F.count_distinct("url").alias("degree"), F.count_if(F.col("action") == "error").alias("attacks"))
    scores = suspect_scores(spark, sf_dir).select(F.col("author").alias("node"), "suspect_score")
    return coordination.cluster_risk(n.join(communities.modular_communities(pairs), "node").join(scores, "node"))


@query("betweenness_exact")
def betweenness_exact(spark, sf_dir):
    """Every node as a source, whatever their number."""
    e = stored(graph.co_occurrence(tables.events(spark, sf_dir), None).select("a", "b", "weight"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return paths.betweenness(e, nodes).withColumn("betweenness", F.round("betweenness", 4))
