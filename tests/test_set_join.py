"""Set-similarity joins against all pairs."""

import random

import pytest

from docloom.operators import joins, set_join


def sets_of(rng, n, copies):
    words = [f"t{i}" for i in range(60)]
    weights = [60 - i for i in range(60)]
    out = {i: set(rng.choices(words, weights, k=rng.randint(1, 14))) for i in range(n)}
    for i in range(n, n + copies):
        out[i] = out[3] if i % 2 else set(sorted(out[rng.randrange(n)])[1:]) or {"t0"}
    return out


def frame(spark, sets, names="id long, entity string"):
    rows = [(i, t) for i, s in sets.items() for t in [*s, min(s)]]
    return spark.createDataFrame([*rows, (None, "t1"), (5000, None)], names).repartition(5)


@pytest.mark.parametrize("threshold, chunk", [(0.6, 4096), (0.3, 7), (1.0, 4096)])
def test_jaccard_matches_all_pairs(spark, monkeypatch, threshold, chunk):
    monkeypatch.setattr(set_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    left, right = sets_of(rng, 60, 30), sets_of(rng, 40, 12)
    right |= {100 + i: (left[i] if i % 3 else left[i] | {"t59", "t58"}) for i in range(30)}
    got = {(r.l, r.r): (r.score, r.overlap) for r in joins.jaccard_recommend(frame(spark, left), frame(spark, right), threshold, 3).collect()}
    want = {(i, j): (round(len(a & b) / len(a | b), 6), sorted(a & b)[:3]) for i, a in left.items() for j, b in right.items() if len(a & b) / len(a | b) >= threshold - 1e-12}
    assert got == want and want


@pytest.mark.parametrize("degree, share, block", [(20, 0.3, 1 << 16), (3, 0.6, 16)])
def test_links_match_all_pairs(spark, monkeypatch, degree, share, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    sets = sets_of(random.Random(degree), 70, 40)
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    kept = {i: {t for t in s if 1 < df[t] <= max(2, share * len(sets))} for i, s in sets.items()}
    want = set()
    for i, a in kept.items():
        near = sorted((-len(a & b), j) for j, b in kept.items() if i < j and len(a & b) >= 2)[:degree]
        want |= {(i, j, -w, tuple(sorted(a & kept[j])[:4]), r) for r, (w, j) in enumerate(near, 1)}
    got = {(r.a, r.b, r.weight, tuple(r.evidence), r.rank) for r in joins.shared_entity_links(frame(spark, sets), "id", "entity", share=share, degree=degree).collect()}
    assert got == want and want


def test_copies_are_one_class(spark):
    """A thousand equal sets and a token of all: candidates are pairs of classes, and links stay linear."""
    rows = [(i, t) for i in range(1000) for t in ("a", "b", "c")] + [(2000 + i, t) for i in range(20) for t in ("a", "b", f"x{i}")]
    sets = spark.createDataFrame(rows, "id long, token string")
    named, members = set_join.classes(sets)
    assert named.count() == 21 and members.count() == 1020
    assert set_join.overlapping(named, 2).count() == 21 * 20 // 2
    links = joins.shared_entity_links(sets, "id", "token", share=1.0, degree=5)
    assert links.where("a < 1000").count() == 5 * 1000 and links.where("a = 0").orderBy("rank").collect()[0].b == 1


def test_empty_sets(spark):
    none = spark.createDataFrame([], "id long, entity string")
    assert joins.jaccard_recommend(none, none).collect() == [] and joins.shared_entity_links(none, "id", "entity").collect() == []


def test_superseded_sets_match_all_pairs(spark):
    rng = random.Random(12)
    old = {i: set(rng.choices(range(12), [12, 9, 7, 5, 4, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 4))) for i in range(60)} | {98: {0}, 99: {0, 77}}
    new = {i: set(rng.choices(range(12), k=rng.randint(0, 7))) for i in range(200, 260)}
    rows = lambda sets: spark.createDataFrame([(i, [*s, *s]) for i, s in sets.items()] + [(500, None)], "id long, members array<long>")
    got = sorted(map(tuple, joins.superseded(rows(old), rows(new)).collect()))
    assert got == sorted((i, j) for i, a in old.items() for j, b in new.items() if a and a < b) and got


def test_superseded_sets_are_fetched_for_few_pairs(spark, monkeypatch):
    """All sets share a member, so that all of other sizes meet; masks leave few pairs whose members are looked at."""
    rng = random.Random(3)
    sets = [(i, [0, *rng.sample(range(1, 60), 3 + i % 4)]) for i in range(120)]
    looked = []
    plain = joins._may_supersede
    monkeypatch.setattr(joins, "_may_supersede", lambda o, n: looked.append(plain(o, n)) or looked[-1])
    frame = spark.createDataFrame(sets, "id long, members array<long>").where("size(members) > 0")
    got = set(map(tuple, joins.superseded(frame, frame).collect()))
    assert got == {(i, j) for i, a in sets for j, b in sets if set(a) < set(b)}
    assert len(got) <= looked[0].count() < 200
