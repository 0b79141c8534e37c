import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest

from murmuration.llm import chat, mixing, perplexity, topk, toxicity, warc
from tests.llm.fixtures import edge_docs, no_docs


# --- perplexity


def test_quality_on_edge_rows(spark):
    docs = edge_docs(spark)
    got = {r.doc_id: r for r in perplexity.quality(docs).collect()}
    assert len(got) == docs.count() and not any(r.kept and r.base_failed for r in got.values())
    assert all(got[k].base_failed for k in range(5)) and all(math.isfinite(r.log_perplexity) for r in got.values())
    assert perplexity.quality(no_docs(spark)).count() == 0


def brute_perplexity(rows, order=6):
    """Log perplexity by document of (doc_id, text, lang): modified Kneser-Ney by the book, in plain dictionaries, with
    every document left out of its own score."""
    out = {}
    for lang in {r[2] for r in rows}:
        own = [(i, bytes(order - 1) + bytes(0 if c <= 32 else c for c in (t or "").encode()) + b"\0") for i, t, x in rows if x == lang]
        grams = {i: [b[k : k + order] for k in range(len(b) - order + 1)] for i, b in own}
        n = {order: collections.Counter(g for gs in grams.values() for g in set(gs))}
        for k in range(order - 1, 0, -1):
            n[k] = collections.Counter(g[1:] for g in n[k + 1])
        cuts, context = {}, {}
        for k in n:
            m = [sum(v == i for v in n[k].values()) for i in range(5)]
            y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
            cuts[k] = [0.0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * (m[i + 1] if i < 4 else 0) / m[i])) if m[1] and m[i] else i * 0.5 for i in (1, 2, 3)]
            context[k] = collections.defaultdict(list)
            for g, v in n[k].items():
                context[k][g[:-1]].append(v)

        def p(g, less):
            k = len(g)
            if not k:
                return 1 / (len(n[1]) + 1)
            v, around = n[k][g], list(context[k][g[:-1]])
            lower = p(g[1:], less and v == 1)
            if less:
                around.remove(v)
                around += [v - 1] if v > 1 else []
                v -= 1
            cut = lambda v: cuts[k][min(v, 3)]
            return (v - cut(v)) / sum(around) + sum(map(cut, around)) / sum(around) * lower if around else lower

        for i, gs in grams.items():
            out[i] = -sum(math.log(max(1e-12, p(g, True))) for g in gs) / len(gs)
    return out


def test_model_matches_kneser_ney_by_the_book(spark):
    docs = edge_docs(spark).filter("n_chars < 20000")
    expected = brute_perplexity([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality(docs).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-5) for k in got)


def test_texts_that_folding_made_equal_are_told_apart(spark):
    r = random.Random(11)
    # a letter 26 code points on fell into the same class
    plain = ["".join(chr(0x4E00 + r.randrange(20)) for _ in range(3)) for _ in range(12)]
    moved = ["".join(chr(ord(c) + 26 * r.randrange(1, 40)) for c in w) for w in plain]
    prose = [" ".join(r.choice(plain) for _ in range(80)) for _ in range(60)]
    rows = [(k, t, "zh") for k, t in enumerate([*prose, " ".join(r.choice(moved) for _ in range(80))])]
    got = {x.doc_id: x for x in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[60].kept and not got[60].base_failed and sum(got[k].kept for k in range(60)) >= 55


def test_the_joined_tail_gives_what_the_head_gives(spark, monkeypatch):
    docs = edge_docs(spark)
    whole = sorted(map(str, perplexity.quality(docs).collect()))
    init = perplexity.gram_model.Head.__init__
    monkeypatch.setattr(perplexity.gram_model.Head, "__init__", lambda self, scored: init(self, scored, 50))
    assert sorted(map(str, perplexity.quality(docs).collect())) == whole


def test_every_language_has_its_own_model(spark):
    texts = {lang: " ".join(random.Random(k).choices([f"{lang}{c}{k}" for c in "abcdefgh"], k=40)) for k, lang in enumerate(f"l{n}" for n in range(20))}
    few = spark.createDataFrame([(1, texts["l19"], "l19"), (2, texts["l19"][:90], "l19")], "doc_id long, text string, lang string")
    rest = spark.createDataFrame([(10 + k, t, lang) for lang, t in texts.items() if lang != "l19" for k in range(3)], few.schema)
    alone, among = ({r.log_perplexity for r in perplexity.quality(d).filter("doc_id < 10").collect()} for d in (few, few.union(rest)))
    assert alone == among


def test_gibberish_is_rejected_and_prose_stays(spark):
    r = random.Random(4)
    words = ["river", "stone", "the", "under", "green", "walks", "and", "old", "house", "sings"]
    prose = [" ".join(r.choice(words) for _ in range(120)) for _ in range(60)]
    noise = "".join(r.choice("qzxjkvwpyfgbm") + (" " if r.random() < 0.2 else "") for _ in range(900))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*prose, noise])], "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in perplexity.quality(docs).collect()}
    assert not got[60] and sum(got[k] for k in range(60)) >= 58


def test_bands_reject_labelled_junk_and_keep_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in perplexity.quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("not base_failed").collect()}
    labels = [(r.quality, kept[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in kept]
    bad, good = [k for q, k in labels if q == 0], [k for q, k in labels if q == 1]
    assert len(bad) > 20 and sum(not k for k in bad) >= 0.6 * len(bad) and sum(not k for k in good) <= 0.02 * len(good)


def test_texts_full_of_symbols_teach_nothing_and_stand_out(spark):
    r = random.Random(6)
    words = ["river", "stone", "the", "under", "green", "walks", "and", "old", "house", "sings"]
    prose = [" ".join(r.choice(words) for _ in range(80)) for _ in range(40)]
    junk = [" ".join(r.choice(words) + r.choice(["###", "$$$", "%%%"]) for _ in range(80)) for _ in range(40)]
    rows = [(k, t, "en") for k, t in enumerate(prose + junk)] + [(100 + k, t, "only") for k, t in enumerate(junk[:4])]
    got = {x.doc_id: x for x in perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # junk is as common as prose and no more likely for it; in the band of both, prose stays
    assert min(got[k].log_perplexity for k in range(40, 80)) > 2 * max(got[k].log_perplexity for k in range(40)) and all(got[k].kept for k in range(40))
    alone = {x.doc_id: x.log_perplexity for x in perplexity.quality(spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")).collect()}
    assert all(math.isclose(alone[k], got[k].log_perplexity, abs_tol=1e-6) for k in range(40)) and all(math.isfinite(got[k].log_perplexity) for k in range(100, 104))


# --- archive


def pages(spark):
    rows = [(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "a\r\nWARC-Type: x", ""), (1, "u1", "<p>é</p>"), (5, "u", "WARC/1.1\r\n" * 3), (None, "n", "only"), (6, "v", "x" * 300000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def brute_records(rows):
    out, own = [], {}
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        b = (r.html or "").encode()
        first = own.setdefault(b, r.page_id)
        again = (b, "seen") in own
        own[b, "seen"] = 1
        out.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark), path)
    records = warc.read_archive(spark, path)
    assert sorted(map(tuple, warc.parse_headers(records).collect()), key=str) == brute_records(pages(spark).collect())
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    whole = [bytes(r.record) for r in warc.record_bytes(records).collect()]
    for b in whole:
        head, _, rest = b.partition(b"\r\n\r\n")
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and len(rest) == n + 4
    warc.export_warc(records, str(tmp_path / "files"))
    import gzip

    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "files").glob("part*")]
    assert sum(map(len, files)) == sum(map(len, whole)) and all(any(b in f for f in files) for b in whole)


def test_damage_is_found_and_an_empty_archive_read(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "a")
    warc.write_archive(pages(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{path}/records").write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="damaged"):
        warc.parse_headers(warc.read_archive(spark, str(tmp_path / "b"))).collect()
    warc.write_archive(pages(spark).limit(0), str(tmp_path / "c"))
    assert warc.read_archive(spark, str(tmp_path / "c")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.write_archive(pages(spark), str(tmp_path / "d"), dedup_from=10**6)
    assert {r.record_type for r in warc.parse_headers(warc.read_archive(spark, str(tmp_path / "d"))).collect()} == {"response"}


# --- chat


def test_log_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 10, "message", "user", "Hi"), (1, 1, 10, "delta", None, " there"), (1, 2, 11, "message", "assistant", "Wrong"), (1, 3, 11, "regenerate", None, None), (1, 4, 11, "delta", None, "Ri"), (1, 5, 11, "delta", None, "ght"), (1, 6, 12, "message", "user", "x"), (1, 7, 12, "edit", None, "y"), (1, 8, 12, "odd", None, "?"), (None, 0, 1, "delta", None, "lone")]
    m = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string"))
    assert sorted((r.conv_id or 0, r.at, r.role, r.text) for r in m.collect()) == [(0, 0, "", "lone"), (1, 0, "user", "Hi there"), (1, 2, "assistant", "Right"), (1, 6, "user", "y")]


def test_a_log_of_drafts_edits_and_deltas_folds_to_its_rows(spark):
    texts = [None, "", "a", "ab", "é🎉<#\\", "x" * 100_000, "draft: ", "two words"]
    rows = [(c, turn, role, t) for c in (1, None) for turn, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "system", None))] + [(1, None, "user", "late"), (1, 3, "user", "tie")]
    log = chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = chat.fold(log).collect()
    assert sorted(map(str, ((m.conv_id, m.at.turn, m.role, m.text) for m in got))) == sorted(map(str, ((c, n, r or "", t or "") for c, n, r, t in rows)))


def test_a_conversation_of_many_turns(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"turn {k} <") for k in range(20_000)]
    out = chat.parse(chat.render(chat.fold(chat.event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert len(out.turns) == 20_000 and out.loss_text == "".join(r[3] for r in rows if r[2] == "assistant")


def test_template_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 3)
    texts = [None, "", chat.PROBE, "\\b\\h\\l\\n", "### user\nhi</turn>\n", "a\\", "é🎉<", "#", "x" * 100000]
    rows = [(1, k, k, "message", ["user", "assistant", "odd\nrole <#\\"][k % 3], t) for k, t in enumerate(texts)]
    out = chat.parse(chat.render(chat.fold(spark.createDataFrame(rows, "conv_id long, seq long, msg long, kind string, role string, text string")))).collect()
    assert [(t.role, t.text) for t in out[0].turns] == [(r[4], r[5] or "") for r in rows]
    assert out[0].loss_text == "".join(r[5] or "" for r in rows if r[4] == "assistant")


def test_no_rows_and_repeated_rows(spark):
    schema = "conv_id long, seq long, msg long, kind string, role string, text string"
    assert chat.parse(chat.render(chat.fold(spark.createDataFrame([], schema)))).count() == 0
    twice = chat.parse(chat.render(chat.fold(spark.createDataFrame([(1, 0, 1, "message", "assistant", "a"), (1, 0, 2, "message", "assistant", "a")], schema)))).first()
    assert len(twice.turns) == 2 and twice.loss_text == "aa"


# --- top-k


def brute_top(cand, asked, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    cand = [(i, ints(v)) for i, v in cand if i is not None and ok(v)]
    out = []
    for q, v in dict((i, v) for i, v in asked if i is not None and ok(v)).items():
        own = ints(v)
        best = sorted((-sum(a * b for a, b in zip(own, w, strict=False)), i) for i, w in cand if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    r = random.Random(9)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(400)] + [(k, [0.5] * 8) for k in range(400, 410)]
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] + [0.0] * 7), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [x for x in rows if x[0] is not None and (x[0] % 50 == 0 or x[0] == 504)]
    for chunk in (100, 10_000):
        got = sorted(tuple(x) for x in topk.top_k(v, v.filter("vec_id % 50 = 0 or vec_id = 504"), chunk=chunk).collect())
        assert got == brute_top(rows, asked, 5)
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
    assert topk.top_k(v.filter("vec_id < 3"), v.filter("vec_id = 0")).count() == 2


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 200, (16, 8))
    vectors = np.floor(np.repeat(centres, 256, 0) + rng.normal(0, 5, (4096, 8)))
    *_, scored = topk.search_chunk(np.array([-1]), vectors[:1], np.arange(4096), vectors, 5)
    assert scored < 64 // 2


def test_blocks_of_a_clustered_table_are_pruned(spark):
    """Over several chunks, with the sample's thresholds: less than half of the blocks are scored, and the result is that
    of brute force."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 16)) * 3
    m = centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    rows = spark.createDataFrame([(k % 3990, [float(x) for x in v], "x", 1) for k, v in enumerate(m)], "vec_id long, embedding array<double>, score string, rank int")
    asked = rows.filter("vec_id % 50 = 0")
    seen = topk.pruning(rows, asked, chunk=1000).agg({"blocks": "sum", "scored": "sum"}).first()
    assert 0 < seen["sum(scored)"] < 0.5 * seen["sum(blocks)"]
    ints, ids = np.floor(256 * m), np.arange(4000) % 3990
    for q in (0, 50, 3950):
        s = (ints @ ints[np.flatnonzero(ids == q)[0]]).astype(int)
        best = sorted((-int(s[i]), int(ids[i])) for i in range(4000) if ids[i] != q)[:5]
        assert [(-r.score, r.vec_id) for r in topk.top_k(rows, asked, chunk=1000).filter(f"query_id = {q}").orderBy("rank").collect()] == best


def test_huge_components():
    v = np.array([[3e17, 1.0], [-3e17, 5.0], [1e16, 2.0]])
    q, i, s, _ = topk.search_chunk(np.array([7]), np.array([[2.0, 3.0]]), np.array([0, 1, 2]), v, 2)
    assert (i, s) == ([0, 2], [2 * 3 * 10**17 + 3, 2 * 10**16 + 6])


# --- toxicity


def test_clauses_not_words():
    g = toxicity.Grammar({"idiot": 3.0})
    plain, directed = g.clause("an idiot"), g.clause("you are an idiot")
    assert directed > plain > g.clause("not an idiot") > 0
    assert g.clause('she wrote "an idiot"') < plain
    assert g.clause("i will kill them") < g.clause("you i will kill") and g.clause("a calm day") == 0
    assert g.features(None) == g.features("") == (0.0, 0.0)
    assert g.features("Not. You IDIOT!") == g.features("you idiot")


def test_the_composed_machine_equals_its_parts_side_by_side():
    r = random.Random(12)
    parts = [toxicity.TARGET_MACHINE, toxicity.NEGATION_MACHINE, toxicity.REPORT_MACHINE]
    to, factor = toxicity.compose(*parts)
    for _ in range(300):
        composed, states = 0, [0, 0, 0]
        for c in r.choices(range(7), k=25):
            steps = [m.step(x, c) for m, x in zip(parts, states, strict=True)]
            expected = math.prod(f for _, f in steps) if c in (toxicity.INSULT, toxicity.THREAT) else 0.0
            assert factor[composed][c] == expected
            composed, states = to[composed][c], [x for x, _ in steps]


def test_clause_scores_against_plain_rules():
    """The same clause read without machines: for each hit its direction, negation and report are looked up afresh."""
    g = toxicity.Grammar({"zork": 1.5})
    vocabulary = ["idiot", "zork", "kill", "you", "not", "said", '"', "walks", "tree"]
    r = random.Random(13)
    for _ in range(400):
        words = r.choices(vocabulary, k=r.randint(1, 14))
        total = 0.0
        for i, w in enumerate(words):
            if w not in ("idiot", "zork", "kill"):
                continue
            f = g.weights[w] * (0.4 if "not" in words[max(0, i - 3) : i] else 1.0)
            quoted = reported = False
            for x in words[:i]:
                if x == '"':
                    quoted, reported = not quoted and True, False
                elif x == "said" and not quoted:
                    reported = True
            f *= 0.6 if quoted or reported else 1.0
            total += f * (1.5 if "you" in words[:i] else 1.4 if "you" in words[i:] else {"kill": 0.2}.get(w, 1.0))
        assert math.isclose(g.clause(" ".join(words)), total, abs_tol=1e-9), words


def test_phrases_of_several_words():
    g = toxicity.Grammar({})
    assert g.features("You are a good for nothing.")[1] > g.features("It is good for nothing else")[1] > 0
    assert g.features("I know where you live!")[0] > 0 and g.features("I know where it lives, they live there")[0] == 0
    assert g.features("drop it, the dead tree")[0] == 0


def test_targets_after_the_hit():
    g = toxicity.Grammar({"idiot": 3.0})
    assert g.clause("i will kill you") > 5 * g.clause("i will kill") > 0 and g.clause("hurt them") > 5 * g.clause("hurt")
    assert g.clause("idiot, you") > g.clause("idiot") and g.clause("not idiot, you") < g.clause("idiot, you")
    assert g.features("kill. you")[1] == g.features("kill")[1]


def test_learned_words_and_held_out(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        t = [word() for _ in range(40)]
        if toxic:
            t[r.randrange(40)] = r.choice(["grobian", "schuft"])
        docs.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    labels += [(1000, 1), (1001, None), (None, 1)]
    docs += [(2000, None), (2001, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar, w = toxicity.train(d, lab)
    got = {x.doc_id: x.score for x in toxicity.score(d, grammar, w).collect()}
    assert sum((got[k] >= 0.5) == (k % 4 == 0) for k in range(400)) >= 396 and got[2000] == got[2001] < 0.5
    grammar, w = toxicity.train(d, lab.limit(0))
    assert toxicity.score(edge_docs(spark), grammar, w).count() == edge_docs(spark).count()
    assert toxicity.score(no_docs(spark), grammar, w).count() == 0


def test_held_out_accuracy_on_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grammar, w = toxicity.train(docs, lab)
    out = toxicity.score(docs.select("doc_id", "text"), grammar, w).join(lab, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    n = {(r.toxic, r.p): r["count"] for r in out.groupBy("toxic", (F.col("score") >= 0.5).alias("p")).count().collect()}
    assert n[1, True] >= 0.85 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.01 * (n[0, False] + n.get((0, True), 0))


# --- mixing


def test_water_level_against_a_loop(spark):
    r = random.Random(6)
    for _ in range(5):
        sizes = {f"s{k}": r.choice([0, 1, 10, 100, 1000, 10**6]) for k in range(r.randint(1, 9))}
        table = spark.createDataFrame([(s, n, float(r.choice([1, 2, 5]))) for s, n in sizes.items()], "source string, source_size long, weight double")
        rows = {x.source: x for x in table.collect()}
        target, free = dict.fromkeys(rows, 0.0), set(rows)
        while free:
            left = sum(sizes.values()) - sum(target[s] for s in rows if s not in free)
            heavy = sum(rows[s].weight for s in free)
            over = {s for s in free if left * rows[s].weight / heavy > 3 * sizes[s]}
            if not over:
                target |= {s: left * rows[s].weight / heavy for s in free}
                break
            for s in over:
                target[s] = 3.0 * sizes[s]
            free -= over
        got = {x.source: x.target for x in mixing.water_fill(table).collect()}
        assert all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-6) for s in rows)


def test_mix_is_near_its_targets_and_repeats(spark):
    docs = edge_docs(spark)
    a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == docs.count()
    by = {}
    for doc, source, size, total, target, repeats, taken in a:
        assert taken == size * repeats <= 3 * size and repeats <= 3
        by.setdefault(source, []).append((size, taken, target, total))
    for rows in by.values():
        assert sum(x[0] for x in rows) == rows[0][3] and abs(sum(x[1] for x in rows) - rows[0][2]) <= max(x[0] for x in rows)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_texts_without_words_are_taken_as_often_as_others_at_most(spark):
    """A small source of a heavy weight is capped at three epochs; what has no words shares the cap."""
    rows = [(k, "", "a") for k in range(6)] + [(10 + k, "some words", "a") for k in range(3)] + [(100 + k, "w " * 500, "b") for k in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.repeats for r in got if r.source == "a"} == {3} and max(r.repeats for r in got) == 3


def test_quality_of_a_text_longer_than_a_block(spark):
    """Base counts and perplexity of one long text equal those by the book; n-grams cross the pieces."""
    r = random.Random(14)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=250_000)), *(" ".join(r.choices(words, k=60)) for _ in range(12))]
    assert len(texts[0].encode()) > 1 << 20
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    expected = brute_perplexity([(k, t, "en") for k, t in enumerate(texts)])
    got = {x.doc_id: x for x in perplexity.quality(docs).collect()}
    assert all(math.isclose(got[k].log_perplexity, expected[k], abs_tol=1e-5) for k in expected)
    assert got[0].n_words == 250_000 and got[0].word_chars == sum(map(len, texts[0].split()))
