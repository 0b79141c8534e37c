"""Queries of the two-model likelihood ratio, of linked accounts and of the suspects' graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.catalogue import query, suspect_scores
from murmuration.operators import communities, coordination, graph, linkage, psi
from murmuration.plans.checkpoints import stored
from murmuration.sources import tables

SUSPECTS = """u AS (SELECT author, least(99, trunc(30 * least(count(*) FILTER (action = 'error') / 20.0::DOUBLE, 1) + 40 * least(count(DISTINCT CASE WHEN action = 'error' THEN url END) / 5.0::DOUBLE, 1))) AS score FROM c GROUP BY 1)"""


def _streams(spark, sf_dir):
    bots = suspect_scores(spark, sf_dir).filter("suspect_score >= 60").select("author")
    return psi.streams(tables.events(spark, sf_dir), bots)


def _psi_actions(group: str, test: str) -> str:
    return f"""{{C}}, {SUSPECTS}, s AS (SELECT c.*, lag(action, 2) OVER w AS b2, lag(action) OVER w AS b1, coalesce(score, 0) AS score, count(*) OVER (PARTITION BY c.author) AS n FROM c JOIN u ON u.author = c.author WINDOW w AS (PARTITION BY c.author ORDER BY us, pos)),
t AS (SELECT * FROM s WHERE b2 IS NOT NULL), k AS (SELECT b2, b1, action, count(*) AS n FROM t WHERE {test} AND n >= 2 GROUP BY ALL), m AS (SELECT b2, b1, sum(n) AS total FROM k GROUP BY ALL), v AS (SELECT count(DISTINCT action) AS v FROM s WHERE {test} AND n >= 2),
p AS (SELECT t.author, CASE WHEN total IS NULL THEN 0.1::DOUBLE / (v + 0.1::DOUBLE * v) ELSE (coalesce(k.n, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v) END AS p FROM t LEFT JOIN k USING (b2, b1, action) LEFT JOIN m USING (b2, b1), v)
SELECT author, round(sum(ln(p)), 5) AS loglik, round(-avg(log2(p)), 6) AS entropy FROM p GROUP BY 1"""


@query("psi_actions_human", _psi_actions("human", "score < 60"))
def psi_actions_human(spark, sf_dir):
    return psi.actions_loglik(_streams(spark, sf_dir), "human").select("author", F.round("loglik", 5).alias("loglik"), F.round("entropy", 6).alias("entropy"))


@query("psi_actions_bot", _psi_actions("bot", "score >= 60"))
def psi_actions_bot(spark, sf_dir):
    return psi.actions_loglik(_streams(spark, sf_dir), "bot").select("author", F.round("loglik", 5).alias("loglik"), F.round("entropy", 6).alias("entropy"))


@query("psi_core")
def psi_core(spark, sf_dir):
    """Times and actions of every actor under models learned from organic actors and from suspects."""
    return psi.psi_scores(_streams(spark, sf_dir))


@query("psi_core_report")
def psi_core_report(spark, sf_dir):
    return psi.psi_report(psi_core(spark, sf_dir))


def _writers(spark, sf_dir):
    """Documents as comments of their source and language, one every ten minutes."""
    return tables.documents(spark, sf_dir).withColumn("us", F.col("pos") * 600_000_000)


@query("account_links")
def account_links(spark, sf_dir):
    return linkage.account_links(stored(linkage.style_prints(_writers(spark, sf_dir))))


@query("account_groups")
def account_groups(spark, sf_dir):
    return linkage.account_groups(stored(linkage.style_prints(_writers(spark, sf_dir))))


PRINTED = """WITH a AS (SELECT source || '/' || lang AS author, doc_id, trim(text, ' ') AS t FROM documents WHERE length(trim(text, ' ')) > 5 AND source IS NOT NULL AND lang IS NOT NULL), k AS (SELECT author, count(*) AS texts FROM a GROUP BY 1 HAVING count(*) >= 3)"""


@query("style_words", PRINTED + rf""", w AS (SELECT author, doc_id::VARCHAR AS url, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT a.*, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') AS ws FROM a JOIN k USING (author))),
z AS (SELECT author, count(*) AS n_all FROM w GROUP BY 1), f AS (SELECT author, w, count(*) AS n, min(url) AS u, min(struct_pack(u := url, i := i)) AS first FROM w WHERE list_contains({linkage.FUNCTION_WORDS}, w) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, first) AS r FROM f) SELECT author, w AS word, round(n / n_all::DOUBLE, 8) AS share FROM r JOIN z USING (author) WHERE r <= 20""")
def style_words(spark, sf_dir):
    """Shares of the words without topic by which accounts are compared."""
    p = linkage.style_prints(_writers(spark, sf_dir)).select("author", F.explode("words").alias("word", "share"))
    return p.select("author", "word", F.round("share", 8).alias("share"))


def _phrases(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return linkage.phrase_pairs(d.select("author", F.col("pos").alias("at"), "text").filter(F.col("author").isNotNull()))


@query("phrase_pairs")
def phrase_pairs(spark, sf_dir):
    """Authors of documents whose first ten texts have like phrases."""
    return _phrases(spark, sf_dir)


@query("suspect_coordination")
def suspect_coordination(spark, sf_dir):
    """One row on the graph of common threads and like phrases: threads are the documents' lengths in hundreds of characters."""
    c = tables.documents(spark, sf_dir).withColumn("url", (F.char_length("text") / 100).cast("int").cast("string"))
    edges = stored(linkage.suspect_graph(graph.co_occurrence(c, 60), _phrases(spark, sf_dir)))
    of = communities.modular_communities(edges)
    n = c.groupBy(F.col("author").alias("node")).agg((F.count_distinct("url") >= 5).alias("suspect"))
    return coordination.graph_coordination(of.join(n, "node"), edges)
