"""Every stage on edge rows, and the whole pipeline against brute force stage by stage."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from murmuration.llm import bpe, mixing, toxicity
from tests.llm.fixtures import edge_docs, no_docs
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_suffix_dedup import brute as cut_brute

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(k, int(k == 12)) for k in range(10, 40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def stage(spark, tables, k, docs, tmp_path):
    out = corpus_pipeline.STAGES[k][1](spark, docs, tables)
    path = str(tmp_path / f"out{k}")
    out.write.parquet(path)
    return spark.read.parquet(path)


def key(rows):
    return sorted(map(str, rows))


def test_stages_on_edge_rows_against_brute_force(spark, tables, tmp_path):
    docs = edge_docs(spark, extra=["you idiot, you moron and loser. you idiot!"])
    last = docs.count() - 1
    a = stage(spark, tables, 0, docs, tmp_path)
    assert a.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()} == {last}

    b = stage(spark, tables, 1, a, tmp_path)
    groups = near_brute([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == {g for g, _ in groups.values()}
    assert key(b.collect()) == key(r for r in a.collect() if groups[r.doc_id][0] == r.doc_id)

    c = stage(spark, tables, 2, b, tmp_path)
    cut = cut_brute([(r.doc_id, (r.text or "").encode()) for r in b.collect()], 200)
    assert c.columns == docs.columns
    for r in c.collect():
        assert r.text == cut[r.doc_id][3].decode("utf-8", "ignore") and r.n_chars == len(r.text)

    d = stage(spark, tables, 3, c, tmp_path)
    times = {r.doc_id: r.repeats for r in mixing.mix(c).collect()}
    assert d.columns == docs.columns and key(d.collect()) == key(r for r in c.collect() for _ in range(times[r.doc_id]))

    e = stage(spark, tables, 4, d, tmp_path)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = lambda t: np.array(reference.encode_ordinary(t or ""), "<u4")
    expected = [(r.doc_id, len(ids(r.text)), hashlib.sha256(ids(r.text).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in d.collect()]
    assert key(map(tuple, e.collect())) == key(expected)


def test_stages_bear_repeated_and_missing_ids(spark, tables, tmp_path):
    docs = edge_docs(spark).limit(14)
    twice = docs.union(docs).union(docs.selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]).limit(3)).repartition(2)
    for k in range(5):
        rows = stage(spark, tables, k, twice, tmp_path)
        assert rows.count() or k == 3


def test_stages_bear_no_rows(spark, tables, tmp_path):
    for k in range(5):
        assert stage(spark, tables, k, no_docs(spark), tmp_path).count() == 0


def test_run_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(5):
        docs = stage(spark, sf, k, docs, tmp_path)
    assert key(map(tuple, corpus_pipeline.run(spark, sf).collect())) == key(map(tuple, docs.collect()))
