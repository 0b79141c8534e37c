import collections
import itertools
import re
from fractions import Fraction

import numpy as np
import pytest

from murmuration.llm import near_dup
from murmuration.llm.components import connected_components
from tests.llm.fixtures import edge_docs, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, t=Fraction(4, 5), n=5):
    sets = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    links, parent = collections.Counter(), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and t.denominator * both >= t.numerator * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (find(i), links[i]) for i in sets}


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.995), (0.5, 0.9), (1.0, 0.99)):
        bands, rows = near_dup.choose_bands(t, r)
        assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= 128
    with pytest.raises(ValueError):
        near_dup.choose_bands(0.01, 0.999)


@pytest.mark.parametrize("block", [384, 2])
def test_classes_and_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", block)
    docs = edge_docs(spark)
    expected = brute([(d.doc_id, d.text) for d in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert got == expected


def test_whole_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute([(d.doc_id, d.text) for d in docs.collect()])


def test_structured_words_are_told_apart(spark):
    """Words that cancel out in a polynomial hash: a Thue-Morse string and its complement."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    docs = spark.createDataFrame([(1, " ".join([x] * 9)), (2, " ".join([y] * 9)), (3, " ".join([x] * 9))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_chain_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 3)
    words = [f"w{k}" for k in range(160)]
    docs = spark.createDataFrame([(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(30)], "doc_id long, text string")
    expected = brute([(d.doc_id, d.text) for d in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()} == expected


def test_null_and_repeated_ids_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text + " more"), (5, "quite other words stand here"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(docs).select("class_id", "n_links").collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (5, 2), (5, 0), (None, 0)], key=str)
    assert near_dup.near_duplicates(no_docs(spark)).count() == 0


def test_link_matrix(monkeypatch):
    monkeypatch.setattr(near_dup, "_COLUMNS", 4)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12))).astype(np.uint64) for _ in range(40)]
    t = Fraction(1, 2)
    real = np.array([[2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for b in sets] for a in sets])
    own = real.copy()
    np.fill_diagonal(own, False)
    assert (near_dup.link_block(sets, None, t) == own).all()
    assert (near_dup.link_block(sets[:15], sets[15:], t) == real[:15, 15:]).all()


def test_components_of_a_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_texts_longer_than_a_block(spark):
    words = [f"w{k}" for k in range(220_000)]
    texts = [" ".join(words), " ".join(words[:200_000] + ["other"] * 500), " ".join(reversed(words)), " ".join(words[:30])]
    assert len(texts[0]) > 1 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()} == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}
