import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from murmuration.llm import bpe, token_counts
from tests.llm.fixtures import edge_docs, no_docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_and_round_trip_on_edge_rows(spark, reference):
    docs = edge_docs(spark)
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, P.PATTERN, digests=True).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        ids = np.array(reference.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_words_of_any_shape(reference):
    r = random.Random(5)
    words = ["a" * 3000, "ab" * 2000, "anananananan", "rewhanananen", "x", "\0", "".join(r.choice("abcdeghinorst") for _ in range(5000)), *("".join(r.choice("anthe ") for _ in range(r.randint(1, 150))).strip() or "q" for _ in range(400))]
    own = bpe.MergeReplay(bpe.load_ranks(PATH), ".+")
    plain = tiktoken.Encoding("w", pat_str=r"(?s).+", mergeable_ranks=own.ranks, special_tokens={})
    got = own.replay([w.encode() for w in words])
    for w, ids in zip(words, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(w), w[:20]


def test_cache_generations(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.MergeReplay(bpe.load_ranks(PATH), P.PATTERN)
    for text in ["one two three four", "five one six", "two zzyzx one", "one two three four" * 30]:
        assert np.frombuffer(own.encode_block([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_a_text_far_longer_than_a_block(monkeypatch, reference):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "WORDS", 37)
    own = bpe.MergeReplay(bpe.load_ranks(PATH), P.PATTERN)
    texts = ["short", " ".join(f"word{k % 700} and{k}" for k in range(3000)), "", "x" * 90]
    expected = [reference.encode_ordinary(t) for t in texts]
    ids = own.encode_block(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == expected and own.encode_block(texts, bpe.counted) == list(map(len, expected))
    assert [own.decode(x).decode() for x in ids] == texts


def test_counts_alone(spark, reference):
    docs = edge_docs(spark)
    got = bpe.encode(docs, PATH, P.PATTERN, counts=True)
    assert got.columns == ["doc_id", "n_tokens"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {d.doc_id: len(reference.encode_ordinary(d.text or "")) for d in docs.collect()}


def test_decode_and_empty(spark):
    coded = bpe.encode(edge_docs(spark).limit(8), PATH, P.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode(coded, PATH, P.PATTERN).collect()}
    assert all(back[d.doc_id] == (d.text or "") for d in edge_docs(spark).collect() if d.doc_id in back)
    assert bpe.encode(no_docs(spark), PATH, P.PATTERN).count() == 0


def test_length_table_matches_brute_force(spark):
    lengths = [3, 3, 0, None, 700, 5, 700, 1024, 3]
    t = token_counts.length_table(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    plain = [x or 0 for x in lengths]
    for r in t.collect():
        n = r.n_tokens
        assert r.n_docs == plain.count(n) and r.docs_ge == sum(x >= n for x in plain) and r.docs_le == sum(x <= n for x in plain)
        assert r.tokens_ge == sum(x for x in plain if x >= n) and r.truncated_total == sum(min(x, n) for x in plain) and r.tokens_total == sum(plain)
    assert {(r.limit, r.docs_over, r.tokens) for r in token_counts.truncated_totals(t, [4, 2000]).collect()} == {(k, sum(x > k for x in plain), sum(min(x, k) for x in plain)) for k in (4, 2000)}
    assert {(r.share, r.n_tokens) for r in token_counts.quantiles(t, [0.5, 1.0]).collect()} == {(0.5, sorted(plain)[4]), (1.0, 1024)}
    assert token_counts.length_table(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_lengths_are_those_of_the_reference(spark, reference):
    docs = edge_docs(spark)
    t = token_counts.length_table(bpe.encode(docs, PATH, P.PATTERN))
    plain = [len(reference.encode_ordinary(d.text or "")) for d in docs.collect()]
    assert {r.n_tokens: r.n_docs for r in t.collect()} == {n: plain.count(n) for n in plain}
