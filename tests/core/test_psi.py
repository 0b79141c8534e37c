"""The two models on seeded streams: what each explains better, and sums written out."""

import math
import random

import pytest

from murmuration.operators import psi

SECOND, HOUR = 1_000_000, 3600
DAY = 19_900 * 86_400


def bursty(seed, hours=24, base=0.004, jump=0.15, decay=0.3):
    """A self-exciting process by thinning, a tenth as active at night; seconds."""
    r, t, out = random.Random(seed), 0.0, []
    while t < hours * HOUR:
        excited = sum(math.exp(-decay * (t - x)) for x in out[-60:])
        bound = 1.2 * (base + jump * excited) + 1e-9
        t += r.expovariate(bound)
        rate = (base + jump * sum(math.exp(-decay * (t - x)) for x in out[-60:])) * (0.1 if not 8 <= t / HOUR % 24 < 22 else 1.2)
        if r.random() < rate / bound and t < hours * HOUR:
            out.append(t)
    return out


def steady(seed, hours=24, rate=0.01):
    r, t, out = random.Random(seed), 0.0, []
    while (t := t + r.expovariate(rate)) < hours * HOUR:
        out.append(t)
    return out


def rows_of(author, times, actions, seed):
    r = random.Random(seed)
    return [(author, "u", int((DAY + t) * SECOND), k, r.choice(actions)) for k, t in enumerate(times)]


@pytest.fixture(scope="module")
def table(spark):
    many, few = ["comment", "react", "share", "publish", "follow"], ["comment", "react"]
    rows = [x for k in range(3) for x in rows_of(f"human{k}", bursty(k), many, k)] + [x for k in range(3) for x in rows_of(f"bot{k}", steady(9 + k), few, k)]
    rows += [("once", "u", DAY * SECOND, 0, "share"), ("?", "u", DAY * SECOND, 1, "share"), ("untimed", "u", None, 2, "share")]
    return spark.createDataFrame(rows, "author string, url string, us long, pos long, action string")


def loglik(times, mu, alpha, beta):
    """The sum over all pairs, and the integral event by event."""
    end = times[-1] - times[0] or 1.0
    log = sum(math.log(mu + alpha * sum(math.exp(-beta * (t - x)) for x in times[:k])) for k, t in enumerate(times))
    return log - mu * end - alpha / beta * sum(1 - math.exp(-beta * (times[-1] - t)) for t in times)


def test_each_model_explains_its_own_streams(spark, table):
    s = psi.streams(table, spark.createDataFrame([(f"bot{k}",) for k in range(3)], "author string"))
    m = psi.fit_times(s)
    mu, alpha, beta = m["human"]
    # children by parent and their pace are found again; the night makes the rate lower than it was by day
    assert 0.3 < alpha / beta < 0.7 and 0.15 < beta < 0.6 and m["bot"][1:] == (0.05, 1.0) and 0.008 < m["bot"][0] < 0.011
    got = {g: {r.author: r.loglik for r in psi.times_loglik(s, *m[g]).collect()} for g in m}
    for k in range(3):
        assert got["human"][f"human{k}"] > got["bot"][f"human{k}"] and got["bot"][f"bot{k}"] > got["human"][f"bot{k}"]
    # as much as any other parameters near
    whole = sum(got["human"][f"human{k}"] for k in range(3))
    for a, b, c in ((1.3, 1, 1), (1, 0.7, 1), (1, 1.3, 1.3)):
        other = {r.author: r.loglik for r in psi.times_loglik(s, mu * a, alpha * b, beta * c).collect()}
        assert sum(other[f"human{k}"] for k in range(3)) < whole
    times = [x / SECOND for x in sorted(r.us for r in table.filter("author = 'human1'").collect())]
    assert got["human"]["human1"] == pytest.approx(loglik(times, mu, alpha, beta), rel=1e-6)

    scores = {r.author: r for r in psi.psi_scores(s, m).collect()}
    assert set(scores) == {f"{g}{k}" for g in ("human", "bot") for k in range(3)}
    for k in range(3):
        h, b = scores[f"human{k}"], scores[f"bot{k}"]
        assert h.psi < b.psi and h.psi < 0 < b.psi and h.diversity > b.diversity and -100 <= h.psi and 0 <= h.confidence <= 1
    row = psi.psi_report(psi.psi_scores(s, m)).first()
    assert row.actors == 6 and 0 < row.score < 100


def test_actions_under_both_groups(spark, table):
    s = psi.streams(table, spark.createDataFrame([("bot0",)], "author string"))
    seqs = {}
    for r in sorted(table.filter("us is not null and author <> '?'").collect(), key=lambda r: (r.author, r.us, r.pos)):
        seqs.setdefault(r.author, []).append(r.action)
    for group, members in (("bot", ["bot0"]), ("human", [a for a in seqs if a not in ("bot0", "once")])):
        counts, vocabulary = {}, {x for a in members for x in seqs[a]}
        for a in members:
            for k in range(2, len(seqs[a])):
                counts.setdefault(tuple(seqs[a][k - 2 : k]), []).append(seqs[a][k])
        for r in psi.actions_loglik(s, group).collect():
            want, x, v = 0.0, seqs[r.author], len(vocabulary)
            for k in range(2, len(x)):
                seen = counts.get(tuple(x[k - 2 : k]))
                want += math.log((seen.count(x[k]) + 0.1) / (len(seen) + 0.1 * v) if seen else 0.1 / (v + 0.1 * v))
            assert r.loglik == pytest.approx(want) and r.entropy == pytest.approx(-want / math.log(2) / (len(x) - 2))


def test_one_operator_in_two_shifts_is_ambiguous_and_models_without_teachers(spark):
    times = bursty(5)
    day, night = [t for t in times if 8 <= t / HOUR < 22][:60], [t for t in times if not 8 <= t / HOUR < 22][:60]
    rows = rows_of("a", day, ["comment", "react", "share"], 1) + rows_of("b", night, ["comment", "react", "share"], 2)
    s = psi.streams(spark.createDataFrame(rows, "author string, url string, us long, pos long, action string"), spark.createDataFrame([], "author string"))
    flat = psi.fit_times(s, 3)
    assert flat["bot"][1:] == (0.05, 1.0) and psi.psi_scores(s, {"human": flat["human"], "bot": flat["human"]}).filter("psi between -30 and 30").count() == 2
    none = s.limit(0)
    assert psi.fit_times(none) == {"human": (0.1, 0.5, 0.3), "bot": (0.1, 0.05, 1.0)} and psi.psi_scores(none).count() == 0


def test_actions_from_texts(spark):
    from pyspark.sql import functions as F

    texts = {"": "react", None: "react", "x": "react", "↪ yes": "reply", "👍": "react", "ok 👍 sure": "comment", "hola": "comment"}
    df = spark.createDataFrame([(t, a) for t, a in texts.items()], "t string, a string")
    assert df.filter(psi.action_of(F.col("t")) != F.col("a")).count() == 0
