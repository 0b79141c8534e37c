"""Components of long paths, in few rounds and with tables in place of checkpoints."""

import random

from murmuration.operators import graph


def test_long_paths_take_few_rounds(spark):
    names = list(range(3000))
    random.Random(3).shuffle(names)
    path = [*zip(names[:1500], names[1:1500]), *zip(names[1500:], names[1501:])]
    rows = [*path, (5000, 5000), (6000, None), (names[3], names[3])]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "a long, b long"), most_rounds=13).collect()}
    low = {n: min(part) for part in (names[:1500], names[1500:]) for n in part}
    assert got == low | {5000: 5000}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0
