import collections
import hashlib
import random

import numpy as np
import pytest

from murmuration.llm import suffix_dedup as s
from tests.llm.fixtures import edge_docs, no_docs


def brute(rows, length):
    n = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = {}
    for key, b in rows:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[key] = len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("hot", [2 << 20, 300])
@pytest.mark.parametrize("length", [200, 40])
def test_removed_bytes_match_brute_force(spark, monkeypatch, hot, length):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "TRANSFORM", 5000)
    docs = edge_docs(spark, extra=["ab" * 400, "b" * 199, "c" * 200, "d" * 201, "é" * 150])
    expected = brute([(d.doc_id, (d.text or "").encode()) for d in docs.collect()], length)
    got = {r.doc_id: tuple(r)[1:] for r in s.dedup(docs, length, form="sha256").collect()}
    assert got == {k: (a, b, c, hashlib.sha256(d).hexdigest()) for k, (a, b, c, d) in expected.items()}


def test_transform_against_brute_force():
    r = random.Random(3)
    for length in (5, 20, 200):
        for _ in range(15):
            base = bytes(r.choice(b"abc") for _ in range(400))
            parts = [bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 30))) + base[a : a + length + r.randrange(0, 80)] for a in (r.randrange(0, 100) for _ in range(r.randint(1, 6)))]
            parts = [p for p in parts if len(p) >= length]
            if not parts:
                continue
            counts = np.array([len(p) - length + 1 for p in parts])
            n = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
            expected = [(k, i) for k, p in enumerate(parts) for i in range(counts[k]) if n[p[i : i + length]] > 1]
            got = [(k, i) for k, lo, hi in zip(*s.repeated_windows(parts, counts, length), strict=True) for i in range(lo, hi + 1)]
            assert sorted(got) == expected


def test_every_window_is_in_one_segment():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab ") for _ in range(n)) for n in (0, 199, 200, 201, 3000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, start, count, anchor, content = s.segments(np.frombuffer(b"".join(texts), np.uint8), offsets)
    windows = sorted((int(k), int(a) + i) for k, a, c in zip(row, start, count, strict=True) for i in range(c))
    assert windows == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)]


def test_forms_ids_and_columns(spark):
    text = "é" + "".join(random.Random(2).choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(1, text, 7), (1, "zz" + text, 8), (None, None, 9)], "doc_id long, text string, n_bytes int")
    out = s.dedup(docs, form="text").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, ""), (1, ""), (1, "zz")]
    kept = s.dedup(docs, form="bytes").collect()
    assert sorted(bytes(r.kept) for r in kept) == [b"", b"", b"zz"] and {r.n_bytes for r in kept} == {0, 402, 404}
    assert s.dedup(no_docs(spark), form="text").count() == 0


def test_one_text_over_several_blocks_and_a_hot_passage(spark, monkeypatch):
    """A text longer than a block with its own repeats, and a passage with other words around it in many texts."""
    monkeypatch.setattr(s, "HOT", 20_000)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))
    long_ = " ".join(word() for _ in range(190_000))
    long_ += passage + long_[5000:5600] + "é" + long_[600_000:600_150]
    texts = [long_] + [" ".join(word() for _ in range(r.randint(0, 30))) + passage[r.randint(0, 40) :] + " ".join(word() for _ in range(20)) for _ in range(150)]
    raw = [t.encode() for t in texts]
    assert len(raw[0]) > 1 << 20
    n = collections.Counter(hash(b[i : i + 200]) for b in raw for i in range(len(b) - 199))
    expected = {}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if n[hash(b[i : i + 200])] > 1:
                gone[i : i + 200] = True
        expected[k] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_removed, x.kept_sha256) for x in s.dedup(docs, form="sha256").collect()} == expected


def test_structured_segments_are_told_apart(spark):
    """Segments that cancel out in a polynomial hash: Thue-Morse strings and their complements."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    rows = [(1, "1" * 9 + x + "2" * 300), (2, "3" * 9 + y + "4" * 300)]
    expected = brute([(k, t.encode()) for k, t in rows], 200)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in s.dedup(spark.createDataFrame(rows, "doc_id long, text string"), form="sha256").collect()}
    assert got == {k: (v[1], v[2]) for k, v in expected.items()}


def test_parts_that_stand_twice_against_parts_laid_out_twice():
    r = random.Random(21)
    for length in (5, 20, 200):
        for _ in range(25):
            base = bytes(r.choice(b"ab") for _ in range(500))
            parts = [base[a : a + length + r.randrange(0, 90)] + bytes(r.choice(b"abc") for _ in range(r.randrange(0, 20))) for a in (r.randrange(0, 150) for _ in range(r.randint(1, 7)))]
            counts, twice = np.array([len(p) - length + 1 for p in parts]), np.array([r.random() < 0.5 for _ in parts])
            n = collections.Counter(p[i : i + length] for p, t in zip(parts, twice, strict=True) for i in range(len(p) - length + 1) for _ in range(2 if t else 1))
            expected = [(k, i) for k, p in enumerate(parts) for i in range(counts[k]) if n[p[i : i + length]] > 1]
            got = [(k, i) for k, lo, hi in zip(*s.repeated_windows(parts, counts, length, twice), strict=True) for i in range(lo, hi + 1)]
            assert sorted(got) == expected
