import math
import random
import re
from collections import Counter

import pytest

from murmuration.llm import lexical_search as m
from tests.llm.fixtures import edge_docs, no_docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=50):
    held = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            extra = 20 * (50 + (50 * n * n_docs) // total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + extra)) for t in set(TERM.findall((text or "").translate(FOLD))) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return sorted(map(str, out))


def plain(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.fixture()
def tables(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 4))) for _ in range(300)]
    own = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(400)]
    docs = [*enumerate(own), (5, own[5]), (5, own[5]), (None, own[7]), *((1000 + k, own[9]) for k in range(70)), (2000, None), (2001, ""), (2002, "-- !"), (2003, "A-b_c 'É' " * 9), (2004, " ".join(r.choices(words, k=60_000)))]
    items = [(k, " ".join(r.choices(words, k=12)).upper()) for k in range(12)] + [(20, own[9]), (21, None), (22, "..."), (23, "a a a b"), (23, "a a a b"), (24, "unheard-of"), (25, own[5] + " " + own[9])]
    return docs, items


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(parts)
    return d, spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("k,size", [(50, None), (5, 4)])
def test_ranks_match_brute_force(spark, tables, monkeypatch, k, size):
    docs, items = tables
    if size:  # several trees, ranges and blocks of queries
        for name, value in (("RANGE", size), ("TREE", 6), ("FAN", 2), ("QUERIES", 7), ("SAMPLE", 3)):
            monkeypatch.setattr(m, name, value)
    got = m.rank(*frames(spark, docs, items), k=k)
    assert plain(got) == brute(docs, sorted(set(items), key=str), k)


def test_no_rows(spark, tables):
    docs, items = tables
    d, i = frames(spark, docs[:3], items[:2])
    assert m.rank(d.limit(0), i).count() == 0 and m.rank(d, i.limit(0)).count() == 0 and m.rank(no_docs(spark), i).count() == 0
    assert m.rank(edge_docs(spark), i).count() >= 0


def test_windows_cut_no_term(monkeypatch):
    text = "Aé-b " + "long" * 50 + " c日d " * 40
    whole = TERM.findall(text.translate(FOLD))
    monkeypatch.setattr(m, "WINDOW", 16)
    assert [t.decode() for some in m.terms(text.encode()) for t in some] == whole


def test_ranges_of_a_clustered_corpus_are_pruned(spark):
    r = random.Random(2)
    topics = [[f"t{k}w{j}" for j in range(40)] for k in range(40)]
    docs = [(64 * k + j, " ".join(r.choices(topics[k], k=30))) for k in range(40) for j in range(64)]
    items = [(k, " ".join(topics[k][:6])) for k in range(40)]
    d, i = frames(spark, docs, items, 1)
    found = m.pruning(d.coalesce(1).orderBy("doc_id"), i, 10).collect()
    assert sum(x.scored for x in found) < 0.2 * sum(x.ranges for x in found)
