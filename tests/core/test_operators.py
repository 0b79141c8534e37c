"""Operators on small fixed inputs, against plain Python."""

import itertools
import random

import pytest

from murmuration.functions import parse, text as txt
from murmuration.operators import actors, graph, models, posts, registry, risk, text, timing
from murmuration.plans.joins import range_self_join, similar_sets
from murmuration.plans.kernels import betweenness, greedy_windows, leader_clusters, merge_pairs
from murmuration.sources import sessions, tables
from murmuration.streaming import monitor
from pyspark.sql import functions as F

SECOND = 1_000_000


def comments(spark, rows):
    """rows of (author, second, url, text)."""
    return spark.createDataFrame([(u, k, a, t or "", None if s is None else int(s * SECOND), 0, "s", "comment") for k, (a, s, u, t) in enumerate(rows)], "url string, pos long, author string, text string, us long, likes int, source string, action string")


@pytest.mark.parametrize("rows_a_slice,width,authors,gap", [(40, 30, 2, 15), (25, 150, 3, None), (1000, 30, 1, 10)])
def test_windows_of_a_stream_without_pauses(spark, rows_a_slice, width, authors, gap):
    """Slices of a few rows, windows over several of them, ties in time: against one scan from left to right."""
    r = random.Random(rows_a_slice)
    at, rows = 0, []
    for k in range(400):
        at += r.choice([0, 1, 2, 9, 14])
        rows.append((f"u{r.randint(0, 5)}" if k % 3 else "u0", at, k))
    least = 12
    found, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][1] <= rows[i][1] + width:
            j += 1
        if j - i >= least and len({x[0] for x in rows[i:j]}) >= authors:
            if gap is not None and found and rows[i][1] - found[-1][1] <= gap:
                found[-1] = (found[-1][0], rows[j - 1][1], found[-1][2] + j - i, found[-1][3] | {x[0] for x in rows[i:j]})
            else:
                found.append((rows[i][1], rows[j - 1][1], j - i, {x[0] for x in rows[i:j]}))
            i = j
        else:
            i += 1
    df = spark.createDataFrame(rows + [("x", None, 999)], "author string, us long, pos long").repartition(3)
    got = greedy_windows(df, width, least, authors, gap, rows_a_slice).collect()
    assert sorted((w.start_us, w.end_us, w.events, w.authors, w.actors) for w in got) == sorted((a, b, n, len(who), sorted(who)) for a, b, n, who in found) and found


def test_waves_equal_a_sequential_scan(spark):
    r = random.Random(1)
    times = sorted(r.uniform(0, 20000) for _ in range(400)) + [None]
    rows = [(r.choice("abcd"), None if t is None else round(t, 3), "u", "") for t in times]
    us = sorted((int(t * SECOND), a) for a, t, *_ in rows if t is not None)
    found, i = [], 0
    while i < len(us):
        own = [x for x in us[i:] if x[0] - us[i][0] <= 60 * SECOND]
        if len(own) >= 3 and len({a for _, a in own}) >= 2:
            found.append([us[i][0], own[-1][0], len(own)])
            i += len(own)
        else:
            i += 1
    merged = []
    for w in found:
        if merged and w[0] - merged[-1][1] <= 30 * SECOND:
            merged[-1][1], merged[-1][2] = w[1], merged[-1][2] + len([1 for x in us if w[0] <= x[0] <= w[1]])
        else:
            merged.append(w)
    got = sorted((w.start_us, w.end_us) for w in timing.attack_waves(comments(spark, rows)).collect())
    assert got == [(a, b) for a, b, _ in merged]


def test_range_join_meets_every_pair_once(spark):
    r = random.Random(2)
    rows = [(k, r.choice("ab"), r.randrange(0, 100)) for k in range(80)] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "pos long, url string, us long")
    got = sorted((x.a_pos, x.b_pos) for x in range_self_join(df, "us", 7, ["url"], lambda a, b: a("pos") != b("pos")).collect())
    rows = rows[:-1]
    assert got == sorted((a[0], b[0]) for a, b in itertools.permutations(rows, 2) if a[1] == b[1] and 0 <= b[2] - a[2] <= 7)


@pytest.mark.parametrize("t", [0.45, 0.65, 0.8])
def test_similar_sets_lose_no_pair(spark, t):
    r = random.Random(3)
    sets = {k: sorted({r.choice("abcdefghijkl") for _ in range(r.randint(1, 9))}) for k in range(60)} | {100: []}
    got = {(x.a, x.b) for x in similar_sets(spark.createDataFrame(list(sets.items()), "k long, t array<string>"), "k", "t", t).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and j(sets[a], sets[b]) >= t}


def test_unknown_authors_and_missing_times(spark):
    c = comments(spark, [("?", 1, "u", ""), (None, 2, "u", ""), ("a", None, "u", ""), ("a", 5, "u", ""), ("b", 6, "u", ""), ("b", 7, "v", "")])
    assert {(r.author, r.n_comments) for r in actors.profiles(c).collect() if r.author in ("a", "b")} == {("a", 1), ("b", 2)}
    assert [(r.a, r.b, r.posts) for r in graph.co_occurrence(c).collect()] == [("a", "b", 1)]
    empty = c.limit(0)
    for f in (actors.velocity, actors.lifecycle, actors.first_movers, timing.attack_waves, timing.sync_pairs, timing.elapsed_bins, posts.post_correlation, models.circadian, models.psi):
        assert f(empty).count() == 0
    assert actors.velocity_campaign(actors.velocity(empty)).first().score == 0


def test_window_bounds_are_closed(spark):
    c = comments(spark, [("a", 0, "u", ""), ("b", 3, "u", ""), ("c", 6.001, "u", "")])
    assert [(r.a, r.b) for r in timing.sync_pairs(c).collect()] == [("a", "b")]
    assert timing.peak_density(c, 3).first().peak == 2


def test_graph_measures(spark):
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)], "a string, b string, weight double")
    assert {r.node: r.component for r in graph.components(path).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    nodes = path.select(F.col("a").alias("node")).union(path.select("b"))
    assert {r.node: r.betweenness for r in betweenness(path, nodes).collect() if r.betweenness} == {"b": 2.0, "c": 2.0}
    assert abs(sum(r.rank for r in graph.pagerank(path, 15).collect()) - 1) < 1e-9
    cliques = spark.createDataFrame([(p + x, p + y, 1.0) for p in "pq" for x, y in itertools.combinations("1234", 2)] + [("p1", "q1", 0.1)], "a string, b string, weight double")
    parts = graph.label_propagation(cliques, 5)
    assert parts.select("community").distinct().count() == 2 and graph.modularity(cliques, parts).first().modularity > 0.4
    assert {r.density for r in graph.cluster_density(cliques, parts).collect()} == {1.0}
    assert graph.gini(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double"), "x").first().gini == 0


def test_kernels(spark):
    v = spark.createDataFrame([(1, {"a": 1.0}), (2, {"a": 1.0, "b": 0.1}), (3, {"c": 1.0}), (4, {})], "id long, terms map<string,double>")
    assert [r.cluster for r in leader_clusters(v, "id", "terms", 0.5, True).orderBy("id").collect()] == [0, 0, 1, 2]
    teams = {r.author: r.team for r in merge_pairs(spark.createDataFrame([("a", "b", 9), ("c", "d", 8), ("b", "c", 7), ("d", "e", 6)], "a string, b string, posts long")).collect()}
    assert teams["a"] == teams["b"] != teams["c"] == teams["d"] == teams["e"]
    assert greedy_windows(comments(spark, [("a", 1, "u", "")]), 10, 2).count() == 0


def test_fusion_redistributes_and_abstains(spark):
    s = spark.createDataFrame([("x", "troll_hunter", 80.0), ("x", "cib_graph", 0.0), ("y", "cib_graph", None), ("z", "troll_hunter", 400.0)] + [("z", d, 100.0) for d in risk.WEIGHTS if d != "troll_hunter"], "k string, dimension string, score double")
    got = {r.k: (r.fused, r.label, r.quality) for r in risk.fuse(s, by=["k"]).collect()}
    assert got == {"x": (79.2, "HIGH", "LOW"), "y": (0.0, "ORGANIC", "INSUFFICIENT"), "z": (99.0, "CRITICAL", "SUFFICIENT")}
    r = {x.author: x.risk for x in risk.actor_risk(spark.createDataFrame([("a", "wave", 0.1), ("a", "copy_paste", 0.1), ("b", "name", 1.0)], "author string, signal string, value double")).collect()}
    assert r == {"a": 60, "b": 9}


def test_manifest_ignores_order(spark):
    i = spark.createDataFrame([("P", "1", "x"), ("A", "2", "y"), ("A", "1", "z")], "category string, key string, detail string")
    h = lambda df: risk.manifest_hash(risk.evidence_manifest(df, "c")).first().manifest_hash
    assert h(i) == h(i.orderBy(F.desc("key")))
    assert [r.item_id for r in risk.evidence_manifest(i, "c").orderBy("item_id").collect()] == ["c-0001", "c-0002", "c-0003"]


def test_registry_and_sessions(spark):
    old, new = spark.createDataFrame([("a", 70), ("b", 40), ("c", 10)], "author string, score int"), spark.createDataFrame([("b", 60), ("c", 12), ("d", 65)], "author string, score int")
    assert {r.author: r.status for r in registry.session_delta(old, new).collect()} == {"a": "DISAPPEARED", "b": "SCORE_UP", "c": "STABLE", "d": "NEW_BOT"}
    assert [r.author for r in registry.insert_ignore(old, new, ["author"]).collect()] == ["d"]
    f = spark.createDataFrame([("a", [1.0, 0.0, 0.1]), ("b", [1.0, 0.0, 0.12]), ("c", [0.0, 1.0, 0.0])], "author string, fingerprint array<double>")
    assert sorted((r.now, r.was, r.identity) for r in registry.identity_matches(f, f).collect()) == [("a", "b", "CONFIRMED"), ("b", "a", "CONFIRMED")]


def test_numbers_dates_and_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for t, n in {"1,5 mil": 1500, "3.2K": 3200, "1.500": 1500, "2 millones": 2000000, "12": 12, "": 0, "1,234,567": 1234567, "4m": 4000000}.items():
        assert one(parse.human_number(F.lit(t))) == n, t
    assert one(parse.human_number(F.lit(None).cast("string"))) == 0
    now = F.lit(10**15)
    for t, s in {"5 min": 300, "hace 3 horas": 10800, "2 days ago": 172800, "ayer": 86400, "just now": 0, "3 semanas": 1814400}.items():
        assert one(parse.relative_micros(F.lit(t), now)) == 10**15 - s * SECOND, t
    assert one(parse.relative_micros(F.lit("soon"), now)) is None
    assert one(txt.normal(F.lit("  Árbol, VERDE!! x_1 "))) == "árbol verde x_1" and one(txt.folded(F.lit("Ñandú"))) == "nandu"
    assert one(txt.word_shingles(F.lit("a b c d"), 3)) == ["a b c", "b c d"] and one(txt.word_shingles(F.lit("a b"), 3)) == ["a", "b"]
    assert one(txt.clean_url(F.lit("http://x/y/?a=1&story_fbid=9&b=2#z"))) == "http://x/y?story_fbid=9" and one(txt.slug(F.lit("Ñu Año 2!"))) == "nu-ano-2"
    assert one(txt.hashtags(F.lit("#Uno y #dos_2"))) == ["uno", "dos_2"] and one(txt.leading_mention(F.lit("@ana hola"))) == "ana"
    assert one(parse.visible_text(F.lit("<p>a<script>b</script> <b>c</b></p>"))) == "a c"
    assert one(tables.parsed_micros(F.lit("2024-01-01T00:00:01Z"))) == one(tables.parsed_micros(F.lit("1704067201"))) == 1704067201 * SECOND


def test_sources_and_sinks(spark, tmp_path):
    import json

    post = {"url": "u1", "source": "s", "text": "t", "timestamp": "2024-01-01T00:00:00", "reactions": 1, "comments_count": 2, "shares": 3, "comments": [{"author": " ", "text": "x", "timestamp": "bad"}, {"author": "a", "text": "y", "timestamp": "2024-01-01T00:00:05", "likes": 2}]}
    folder = tmp_path / "s" / "slug" / "20240102_030405"
    folder.mkdir(parents=True)
    (folder / "posts_latest.json").write_text(json.dumps([post, {"url": "u2"}]))
    (folder / "session.json").write_text(json.dumps({"query_slug": "slug", "post_count": 2}))
    p = sessions.read_session_posts(spark, str(folder))
    assert p.count() == 2 and tables.read_posts(spark, str(folder / "posts_latest.json")).filter("us is not null").count() == 1
    assert [(r.author, r.us is None, r.likes) for r in tables.comments_of(p).orderBy("pos").collect()] == [("?", True, 0), ("a", False, 2)]
    assert sessions.read_sessions(spark, str(tmp_path / "s")).first().session_us == 1704164645 * SECOND
    (tmp_path / "targets.json").write_text(json.dumps({"targets": [{"name": "n", "handle": "h"}]}))
    assert sessions.read_targets(spark, str(tmp_path / "targets.json")).first().handle == "h"
    (tmp_path / "body").write_text('{"a": 1}\nno json\n{"data": {"serpResponse": {"results": {"edges": [{"story": {"url": "z", "message": {"text": "m"}, "creation_time": "1704067200"}}]}}}}')
    assert [(r.url, r.text) for r in sessions.stories(sessions.read_api_bodies(spark, str(tmp_path / "body"))).collect()] == [("z", "m")]
    sessions.write_csv(p, str(tmp_path / "csv"))
    sessions.write_urls(p, str(tmp_path / "urls"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.text(str(tmp_path / "urls")).count() == 2


def test_upsert_dedup_and_sentiment(spark):
    p = spark.createDataFrame([("u", 0, "", "a", None, 1, 2, 3), ("u", 1, "s", "longer", 5, 4, 1, 0), ("", 2, "s", "same", 1, 0, 0, 0), (None, 3, "s", "same", 1, 0, 0, 0)], "url string, pos long, source string, text string, us long, reactions int, comments_count int, shares int")
    u = posts.upsert_posts(p).filter("url = 'u'").first()
    assert (u.text, u.source, u.us, u.engagement_total) == ("longer", "s", 5, 9)
    assert sorted(r.pos for r in posts.dedup_posts(p).collect()) == [0, 2]
    lex = spark.createDataFrame([("bad", "negative", 6.0), ("good", "positive", 6.0)], "word string, polarity string, score double")
    rows = spark.createDataFrame([(1, "bad"), (2, "not bad"), (3, "very good"), (4, None)], "id long, text string")
    assert {r.id: (r.negative, r.positive, r.label) for r in text.sentiment(rows, lex, ["id"], negators=["not"], boosters=["very"]).collect()} == {1: (0.5, 0.0, "NEGATIVE"), 2: (0.275, 0.0, "NEGATIVE"), 3: (0.0, 0.725, "POSITIVE"), 4: (0.0, 0.0, "NEUTRAL")}


def test_streams_match_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(open(src, "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = monitor.tumbling_counts(stream).select("w.start", "event_type", "n").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = monitor.tumbling_counts(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))).select("w.start", "event_type", "n")
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, batch.collect()))


def test_monitor_alerts_between_cycles(spark, tmp_path):
    schema = "user_id long, score int"
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    cycle = lambda b: b.agg(F.count_if(F.col("score") > 60).alias("new_bots"), F.max("score").alias("score"), F.lit(0).alias("new_terms"), F.sum("score").alias("engagement"))
    (folder / "1.json").write_text('{"user_id": 1, "score": 20}')
    q = monitor.start_monitor(stream, cycle, str(tmp_path / "state"), lambda a, n: seen.extend(a.collect()), str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    (folder / "2.json").write_text('{"user_id": 1, "score": 80}')
    q.processAllAvailable()
    q.stop()
    assert [(r.alert, r.severity) for r in seen] == [("CIB_SPIKE", "CRITICAL")]


def test_betweenness_takes_every_source_and_many_edges(spark):
    from murmuration import catalogue

    # a path: node k of n lies between k * (n - 1 - k) pairs
    path = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(59)], "a string, b string, weight double")
    got = {r.node: r.betweenness for r in catalogue._betweenness(path).collect()}
    assert got == {f"n{k:03}": float(k * (59 - k)) for k in range(60)}
    many = spark.range(200_001).selectExpr("'hub' as a", "concat('x', id) as b", "1.0D as weight")
    assert betweenness(many, spark.createDataFrame([("x0",)], "node string"), None).filter("node = 'hub'").first().betweenness == 100_000.0
    # a star of 401 nodes: 50 of them stand for all
    star = many.filter("b in ('x0')").union(spark.range(1, 400).selectExpr("'hub' as a", "concat('x', id) as b", "1.0D as weight"))
    hub = catalogue._betweenness(star).filter("node = 'hub'").first().betweenness
    assert abs(hub / (400 * 399 / 2) - 1) < 0.05


def test_influence_and_roles_take_the_real_betweenness(spark, monkeypatch):
    from murmuration import catalogue

    # two cliques and a broker between them, of the least degree
    cliques = [(p + x, p + y) for p in "pq" for x, y in itertools.combinations("12345", 2)]
    e = spark.createDataFrame([(a, b, 1, 1.0) for a, b in [*cliques, ("m", "p1"), ("m", "q1")]], "a string, b string, posts long, weight double")
    monkeypatch.setattr(catalogue, "_edges", lambda spark, sf_dir: e)
    suspects = spark.createDataFrame([(n, 80 if n == "p5" else 0) for n in {x for r in e.collect() for x in (r.a, r.b)}], "author string, suspect_score int")
    monkeypatch.setattr(catalogue, "suspect_scores", lambda spark, sf_dir: suspects)
    n = {r.node: r for r in catalogue.influence(spark, "").collect()}
    assert len(n) == 11 and n["m"].influence > n["p2"].influence and round(n["p5"].influence - n["p4"].influence, 2) == 16.0
    roles = {r.node: r.role for r in catalogue.roles(spark, "").collect()}
    assert roles["p1"] == roles["q1"] == "COMMAND" and roles["p2"] == "HUB" and roles["p5"] == "AMPLIFIER"


def test_kernels_take_rows_past_the_former_bounds(spark):
    v = spark.range(5_200).selectExpr("id", "map(concat('t', id % 50), 1.0D) as terms")
    got = leader_clusters(v, "id", "terms", 0.5, False)
    assert got.count() == 5_200 and got.filter("cluster != id % 50").count() == 0
    teams = merge_pairs(spark.range(10_300).selectExpr("concat('a', id) as a", "concat('b', id) as b", "20000 - id as posts"))
    assert teams.count() == 2 * 10_300 and teams.filter("author in ('a10299', 'b10299')").select("team").distinct().count() == 1


def test_components_over_all_orders(spark):
    import math

    from murmuration import catalogue

    sf = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_totalprice").collect():
        a, b = find(r.o_custkey), find(-1 - (r.o_custkey * 7 + math.floor(r.o_totalprice)))
        root[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in catalogue.QUERIES["components_all"](spark, sf).collect()} == {x: find(x) for x in root}


def test_sentiment_against_a_plain_reading(spark):
    """Negation, intensifiers, capitals, slang, phrases and priorities, word by word in plain Python."""
    import random
    import re

    from murmuration.operators import feeds

    lexicon = [("malo", "neg", 3.0), ("bueno", "pos", 4.0), ("basura", "agg", 5.0), ("muy mal", "neg", 2.0), ("hijo de puta", "agg", 6.0), ("no", "neg", 0.5)]

    def plain(text):
        low = text.strip().lower()
        for a, b in feeds.SLANG.items():
            low = re.sub(rf"\b{a}\b", b, low)
        words, said, total, hits = re.split(r"\W+", low), text.split(), {"neg": 0.0, "pos": 0.0, "agg": 0.0}, []
        for p, d, v in lexicon:
            if " " in p and p in low:
                total[d] += v
        for i, w in enumerate(words):
            turned, strong = set(words[max(0, i - 4) : i]) & set(feeds.NEGATION), set(words[max(0, i - 2) : i]) & set(feeds.INTENSIFIER)
            f = (0.55 if turned else 1.45 if strong else 1.0) * (1.3 if i < len(said) and said[i].isupper() and len(said[i]) > 2 else 1.0)
            for p, d, v in lexicon:
                if p == w:
                    total[d] += v * f
        n, p, a = (round(min(x / 12, 1), 3) for x in (total["neg"] + 0.4 * total["agg"], total["pos"], total["agg"]))
        return n, p, a, "AGRESIVO" if a >= 0.15 else "NEGATIVO" if n >= 0.15 else "POSITIVO" if p >= 0.15 else "NEUTRAL"

    r = random.Random(5)
    words = ["malo", "MALO", "bueno", "BUENO", "basura", "Basura", "no", "muy", "mal", "hdp", "q", "nunca", "re", "casa", "y,", "más"]
    texts = ["", " ", "hdp", "no es malo", "MUY MAL, muy mal"] + [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x.id: (x.negative_score, x.positive_score, x.aggressive_score, x.label) for x in feeds.sentiment(rows, spark.createDataFrame(lexicon, "phrase string, dimension string, score double"), ["id"]).collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        assert got[k][3] == want[3] and all(abs(x - y) < 0.0011 for x, y in zip(got[k][:3], want[:3], strict=True)), (t, got[k], want)


def test_bursts_of_posts(spark):
    from murmuration.operators import feeds

    text = "uno dos tres cuatro cinco seis siete"
    minute = 60_000_000
    rows = [("a", 0, "s1", text, 0), ("b", 1, "s2", text, 90 * minute), ("c", 2, "s3", text + " ocho", 30 * minute), ("d", 3, "s1", text, 5 * minute), ("e", 4, "s4", "otra cosa por completo aquí", 6 * minute), ("f", 5, "s5", text, 90 * minute + 1), ("g", 6, "s6", text, None)]
    got = feeds.post_bursts(spark.createDataFrame(rows, "url string, pos long, source string, text string, us long")).collect()
    assert sorted((x.start_min, x.url, x.posts, x.sources, x.span_min) for x in got) == [(0, "a", 3, 3, 90), (5, "d", 4, 4, 85), (30, "c", 3, 3, 60)]


def test_communities_above_a_bar(spark):
    from murmuration.operators import coordination

    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.2), ("c", "d", 0.5), ("x", "y", 0.1), ("a", "a", 9.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    got = {r.node: r.community for r in coordination.threshold_communities(edges, nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "x", "z": "z"}


def test_comment_times_and_other_forms(spark):
    from pyspark.sql import functions as F

    from murmuration.operators import feeds

    day, hour = 86_400_000_000, 3_600_000_000
    now = 19_900 * day + 15 * hour
    forms = {"2 h": now - 2 * hour, "· 14 h · Editado": now - 14 * hour, "3 sem": None, "3 semanas": now - 21 * day, "hace 5 días": now - 5 * day, "ayer": 19_899 * day + 12 * hour, "3 de enero": 19_725 * day + 12 * hour, "31 de feb de 2024": None, "5 min": now - 300_000_000, "": None, "Ana": None}
    rows = spark.createDataFrame([(x,) for x in forms], "t string")
    assert {r.t: r.us for r in rows.select("t", feeds.comment_micros(F.col("t"), F.lit(now)).alias("us")).collect()} == forms


def test_session_orders_and_lists(spark):
    from murmuration.operators import feeds

    assert feeds.query_list(["a, b", "b", " c ,a"]) == ["a", "b", "c"]
    d = spark.createDataFrame([("u", "STABLE", 1), ("v", "SCORE_UP", 20), ("w", "NEW_BOT", 70), ("x", "MINOR", 99), ("y", "SCORE_UP", -30)], "author string, status string, delta int")
    assert [r.author for r in feeds.status_order(d).collect()] == ["w", "y", "v", "u", "x"]
    p = spark.createDataFrame([(1, "AGRESIVO"), (2, "NEUTRAL"), (3, "NEGATIVO")], "id int, label string")
    assert [{r.id for r in feeds.mode_filter(p, m).collect()} for m in ("negative", "aggressive", "all", "odd")] == [{1, 3}, {1}, {1, 2, 3}, {1, 3}]
    t = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("u", 3, "a")], "k string, at int, v string")
    assert feeds.ordered_distinct(t, "k", "v", "at").first()["values"] == ["a", "b"]
