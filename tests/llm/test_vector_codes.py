import hashlib
import math

import numpy as np

from murmuration.llm import vector_codes as m


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, code, error, label_error, digest) by plain loops over Python integers."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(1, max(len(v) for _, _, v in kept)) // parts) * parts
    kept = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    own = width // parts
    cut = lambda v, p: v[p * own : (p + 1) * own]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for k, g in groups.items():
                book[k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, lab, [near(cut(v, p), books[p]) for p in range(parts)]) for i, lab, v in kept]
    by_label = {}
    for _, lab, f in found:
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[lab], digest) for i, lab, f in found]


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, "clash", 1) for i, lab, v in rows], "vec_id long, label int, embedding array<float>, code string, error int").repartition(3)


def plain(df):
    return sorted(map(str, map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())))


def test_codes_match_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8))
    rows = [(int(k), int(k % 5) if k % 7 else None, [float(np.float32(x)) for x in centres[k % 20] * (k % 3) + r.normal(size=8) * 0.2]) for k in r.permutation(700)]
    rows += [(900, 1, None), (901, 1, [0.1] * 7 + [None]), (902, 1, [math.nan] + [0.0] * 7), (903, 1, [math.inf] + [0.0] * 7), (904, None, [0.5] * 8), (904, None, [0.5] * 8), (None, 2, [-0.25] * 8)]
    assert plain(m.compress(table(spark, rows))) == sorted(map(str, brute(rows)))


def test_few_short_and_no_vectors(spark):
    rows = [(3, 0, [1.0, 2.0, 3.0]), (1, 0, [0.5, -0.5, 0.25, 4.0, 1.0]), (2, None, [])]
    assert plain(m.compress(table(spark, rows))) == sorted(map(str, brute(rows)))
    assert m.compress(table(spark, rows).limit(0)).count() == 0
    assert plain(m.compress(table(spark, [(1, 1, None), (2, 1, [1.0] * 4)]))) == sorted(map(str, brute([(2, 1, [1.0] * 4)])))


def test_huge_components_are_exact(spark):
    rows = [(k, 0, [float(np.float32(1e6 * (k % 3) + k)), 0.0, 0.25 * k, 3.0e5]) for k in range(300)]
    assert plain(m.compress(table(spark, rows))) == sorted(map(str, brute(rows)))


def test_bounds_hold_and_leave_few_candidates():
    r = np.random.default_rng(1)
    book, q = r.integers(-300, 300, (256, 16)), r.integers(-300, 300, (500, 16))
    book[10] = book[9]  # a tie
    q[0] = book[9]
    cells = m.Cells(book)
    distance = ((q[:, None, :] - book[None]) ** 2).sum(2)
    lower, upper = cells.bounds(q)
    assert (lower <= distance).all() and (distance <= upper).all()
    entry, least, refined = cells.nearest(q)
    assert (entry == distance.argmin(1)).all() and (least == distance.min(1)).all() and entry[0] == 9 and refined < 0.3 * distance.size


def test_decode_gives_the_entries(spark):
    r = np.random.default_rng(2)
    rows = [(k, 0, [float(np.float32(x)) for x in r.normal(size=8)]) for k in range(40)]
    kept, width = m.integer_vectors(table(spark, rows))
    books = m.fit_codebooks(kept, width)
    coded = m.decode(m.encode(kept, books, width), books).drop("label")
    for x in coded.join(kept.drop("label"), "vec_id").collect():
        assert sum((a - b) ** 2 for a, b in zip(x.approximation, x.v, strict=True)) == x.error
