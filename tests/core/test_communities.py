"""Communities against a sequential search for the highest modularity."""

import itertools
import random

import pytest

from murmuration.operators import communities, coordination, graph


def modularity(edges, of, gamma=1.0):
    m = sum(edges.values())
    k, inside = {}, 0.0
    for (a, b), w in edges.items():
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += w * (of[a] == of[b])
    tot = {}
    for n, x in k.items():
        tot[of[n]] = tot.get(of[n], 0) + x
    return inside / m - gamma * sum(x * x for x in tot.values()) / (4 * m * m)


def sequential(edges, nodes):
    """Local moving in order of the nodes, then the same with communities as nodes, until nothing rises."""
    of = {n: n for n in nodes}
    while True:
        before = modularity(edges, of)
        groups = sorted(set(of.values()))
        moved = True
        while moved:
            moved = False
            for g in groups:
                own = [n for n in nodes if of[n] == g]
                if not own:
                    continue
                start, best = modularity(edges, of), None
                for c in sorted({of[b if a in own else a] for a, b in edges if (a in own) != (b in own)}):
                    q = modularity(edges, of | dict.fromkeys(own, c))
                    if q > start + 1e-9:
                        start, best = q, c
                if best is not None:
                    of.update(dict.fromkeys(own, best))
                    moved = True
        if modularity(edges, of) <= before + 1e-9:
            return of


def planted(seed, sizes, inside, outside):
    r = random.Random(seed)
    of = {f"n{k:03}": g for k, g in enumerate(x for g, n in enumerate(sizes) for x in [g] * n)}
    return {(a, b): float(r.randint(1, 3)) for a, b in itertools.combinations(sorted(of), 2) if r.random() < (inside if of[a] == of[b] else outside)}


@pytest.mark.parametrize("edges", [planted(1, [8, 8, 8, 6], 0.8, 0.05), {(f"n{a}", f"n{b}"): 1.0 for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (6, 7)]}])
def test_not_below_the_sequential_search(spark, edges):
    nodes = sorted({n for e in edges for n in e})
    df = spark.createDataFrame([(b, a, w) for (a, b), w in edges.items()] + [(nodes[0], nodes[1], 0.0)], "a string, b string, weight double")
    got = {r.node: r.community for r in communities.modular_communities(df, spark.createDataFrame([("alone",)], "node string")).collect()}
    assert got.pop("alone") == "alone" and set(got) == set(nodes) and all(got[c] == c == min(n for n in got if got[n] == c) for c in got.values())
    assert modularity(edges, got) >= modularity(edges, sequential(edges, nodes)) - 1e-9


def test_no_edges(spark):
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert communities.modular_communities(none).count() == 0
    assert [tuple(r) for r in communities.modular_communities(none, spark.createDataFrame([("x",)], "node string")).collect()] == [("x", "x")]


def test_bots_of_one_text_and_rhythm_stand_out(spark):
    """Five bots, two seconds apart with one text a post, on five posts; three people, minutes apart, on five others."""
    second = 1_000_000
    rows = [(f"p{p}", k, f"bot{k}", f"same words of post {p}", (p * 3600 + 2 * k) * second) for p in range(5) for k in range(5)]
    rows += [(f"p{p}", k, f"man{k}", f"own words {p} {k} of mine", (p * 3600 + 615 * k) * second) for p in range(5, 10) for k in range(3)]
    c = spark.createDataFrame(rows, "url string, pos long, author string, text string, us long")
    pairs = communities.normalised(coordination.comment_pairs(c))
    of = communities.modular_communities(pairs)
    got = {r.community: r for r in coordination.coordinated_communities(c, of, pairs).collect()}
    assert {k: (v.size, v.coordinated) for k, v in got.items()} == {"bot0": (5, True), "man0": (3, False)}
    # of ten pairs a post those up to 3 s apart are four; all five share their texts
    assert (got["bot0"].density, got["bot0"].sync, got["bot0"].likeness, got["bot0"].score) == (1.0, 0.4, 1.0, 76.0) and got["man0"].sync == 0
    slices = spark.createDataFrame([(s, f"bot{k}", "x") for s in range(3) for k in range(2)], "slice int, author string, community string")
    row = communities.network_summary(spark.createDataFrame(list(got.values())), spark.createDataFrame([("bot0", 80.0)], "author string, score double"), slices).first()
    assert (row.clusters, row.mean_size, row.leaders, row.ghosts, row.organised) == (2, 4.0, 2, 1, True) and row.score == round((5 * 76.0 + 3 * got["man0"].score) / 8, 1)
    assert graph.modularity(pairs, of).first()[0] == 0.355


def test_betweenness_in_tables_equals_the_kernel(spark):
    from murmuration.plans.kernels import betweenness

    edges = planted(4, [5, 5], 0.7, 0.2)
    df = spark.createDataFrame([(a, b, w / 4) for (a, b), w in edges.items()] + [("x", "y", 1.0), ("x", "x", 1.0), ("y", "z", None)], "a string, b string, weight double")
    nodes = graph.degree(df.filter("weight > 0")).select("node")
    want = {r.node: r.betweenness for r in betweenness(df.filter("weight > 0 and a <> b"), nodes, None).collect()}
    for batch in (7,):
        got = {r.node: r.betweenness for r in graph.betweenness_tables(df, nodes.union(spark.createDataFrame([("no",)], "node string")), batch).collect()}
        assert {n for n, x in got.items() if x > 0} == {n for n, x in want.items() if x > 0} and all(abs(got[n] - x) < 1e-6 for n, x in want.items())
        assert got["x"] == 0 and "no" not in got
