"""Rows that every operator has to bear: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, spans string, node int, repeats string"


def edge_docs(spark, extra=()):
    """Documents with edge rows first, then near and exact copies and shared passages from a seeded generator."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioubcdnrst") for _ in range(r.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [None, "", " \n\t ", "one", "two words", "é ü 日本語 🎉", "a" * 5000, "a\nb\na\n\na", "same line here\nsame line here\nother", "x " * 300]
    base = [" ".join(sentence(r.randint(8, 20)) for _ in range(r.randint(6, 12))) for _ in range(30)]
    passage = sentence(70)
    texts += base + base[:5] + base[:2]
    texts += [b.replace(b.split()[10], "changed", 1) for b in base[5:10]]
    texts += [base[k] + " " + passage + " " + base[k + 1] for k in range(12, 18)]
    texts += [" ".join(sentence(15) for _ in range(2500)), *extra]
    langs, sources = ["en", "fr", None, "de"], ["s1", "s2", None, "s3", "s4"]
    rows = [(k, t, langs[k % 4], sources[k % 5] if k % 3 else "s1", len(t or ""), 0.5, "x", "y", k, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
