"""Sets over few tokens, multiplied tile by tile, against all pairs."""

import random

import pytest

from docloom.operators import incidence, joins, rollups


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in (("FEW", 0), ("TILE", 16), ("PART", 2), ("SLICE", 5)):
        monkeypatch.setattr(incidence, name, value)


def sets_of(rng, n, most):
    return {i: set(rng.sample(range(20), rng.randint(1, most))) for i in range(n)}


def frame(spark, sets):
    rows = [(i, t) for i, s in sets.items() for t in [*s, min(s)]]
    return spark.createDataFrame([*rows, (None, 1), (5000, None)], "id long, entity long").repartition(5)


@pytest.mark.parametrize("once", [False, True])
def test_jaccard_matches_all_pairs(spark, monkeypatch, once):
    rng = random.Random(5)
    left = sets_of(rng, 70, 14)
    right = left if once else sets_of(rng, 41, 20)
    monkeypatch.setattr(joins.set_join, "classes", None)  # the join is not taken
    got = [(r.l, r.r, r.score, r.overlap) for r in joins.jaccard_recommend(frame(spark, left), frame(spark, right), 0.4, 3, once=once).collect()]
    want = [(i, j, round(len(a & b) / len(a | b), 6), sorted(a & b)[:3]) for i, a in left.items() for j, b in right.items() if len(a & b) / len(a | b) >= 0.4 - 1e-12 and (i < j or not once)]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("most", [3, 16])
def test_expansion_matches_all_pairs(spark, monkeypatch, most):
    rng = random.Random(most)
    sets = sets_of(rng, 70, most)
    weight = {i: rng.randint(-3, 9) for i in sets}
    want = set()
    for i, a in sets.items():
        score = {}
        for j, b in sets.items():
            for t in b - a if i != j and a & b else ():
                score[t] = score.get(t, 0) + weight[j]
        want |= {(i, t, w, r) for r, (t, w) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:8], 1)}
    asked = []
    monkeypatch.setattr(rollups.incidence, "expansions", lambda *a, real=incidence.expansions: asked.append(1) or real(*a))
    buckets = spark.createDataFrame([(i, sorted(s), weight[i]) for i, s in sets.items()], "k long, toks array<long>, w long").repartition(3)
    got = {(r.k, r.token, r.weight, r["rank"]) for r in rollups.cooccurrence_expansion(buckets, "k", "toks", "w").collect()}
    assert got == want and want and asked


def test_sets_over_many_tokens_are_joined(spark, monkeypatch):
    each = spark.createDataFrame([(i, i + j) for i in range(3000) for j in range(2)], "id long, token long")
    assert incidence.dense(each) is None
