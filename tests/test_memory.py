"""Memory search and tiered context against worked cases and plain scores."""

import numpy as np
import pytest

from docloom.operators import memory
from docloom.plans import memories as plans

SHAPE = "item_id long, embedding array<double>"


@pytest.mark.parametrize("block", [1024, 3])
def test_nearest_many_matches_plain_scores(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(80)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(300, [0.0] * 5), (301, [1.0]), (302, None), (None, [1.0] * 5)]
    asked = [(i, rng.normal(size=5).tolist()) for i in range(7)] + [(50, [2.0, 0.0, 0.0, 0.0, 0.0]), (51, [0.0] * 5), (52, None), (53, [3.0])]
    got = {}
    for r in memory.nearest_many(spark.createDataFrame(rows, SHAPE).repartition(4), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    want = {}
    for q, v in asked:
        scores = []
        for i, u in rows:
            if v and u and i is not None and len(u) == len(v) and any(u) and any(v):
                scores.append((-round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 6), i))
        if scores:
            want[q] = [(i, pytest.approx(-s, abs=1e-6)) for s, i in sorted(scores)[:6]]
    assert got == want and [i for i, _ in got[50]] == [200, 201, 202, 203, 204, 205]


def test_tiers(spark):
    now = plans.NOW
    a, b = [1.0, 0.0], [0.0, 1.0]
    vectors = spark.createDataFrame([(i, a) for i in range(1, 6)] + [(i, b) for i in range(6, 9)], SHAPE)
    week = (plans.MONDAY - 3 * plans.DAY, plans.MONDAY - 2 * plans.DAY)
    rows = [(1, "semantic", 0, 1, False, False), (2, "semantic", 0, 1, True, False), (3, "episodic", *week, False, False), (4, "episodic", 0, 1, False, False), (5, "semantic", 0, 1, False, True), (6, "semantic", 0, 1, False, False)]
    mem = spark.createDataFrame([(*r, f"summary {r[0]}") for r in rows], "memory_id long, kind string, window_start long, window_end long, cold boolean, superseded boolean, summary string")
    questions = [(10, "overview of things", a), (11, "what did we decide last week about the contract and its parts", a), (12, "where is fn parse_header() in src/lib.rs defined and how", a), (13, "overview of things", [0.7, 0.8]), (14, "overview", None), (15, "overview of things", [0.6, -1.0])]
    asked = spark.createDataFrame(questions, "query_id long, text string, embedding array<double>")
    results = spark.createDataFrame([(q, r, 100 + r, "t", "raw", 1.0 / r) for q in range(10, 17) for r in (1, 2, 3)], "query_id long, rank int, item_id long, title string, content string, score double")
    out = {}
    frame = memory.assemble(asked, mem, vectors, results, now)
    for r in frame.orderBy("query_id", "pos").collect():
        out.setdefault(r.query_id, [r.shape, r.tier]).append((r.source, r.id))
    raw = [("item", 101), ("item", 102), ("item", 103)]
    assert out[10] == ["overview", "L3", ("memory", 1), ("memory", 6), ("item", 101)]  # not the cold one, not the superseded one
    assert out[11] == ["recall", "L2", ("memory", 3), ("item", 101)]
    assert out[12] == ["precise", "L0", *raw] and out[14] == ["overview", "L0", *raw] and out[15] == ["overview", "L0", *raw]
    assert out[13] == ["overview", "L3", ("memory", 6), ("memory", 1), ("item", 101)]
    total = {r.query_id: r.total for r in frame.collect()}
    assert total[12] == 3 * 2 and all(sum(r.tokens for r in frame.collect() if r.query_id == q) == t for q, t in total.items())
    off = memory.assemble(asked, mem, vectors, results, now, enabled=False)
    assert {(r.shape, r.tier, r.source) for r in off.collect()} == {("precise", "L0", "item")}
    assert memory.assemble(asked.limit(0), mem, vectors, results, now).collect() == []


def test_query_reaches_every_tier(spark):
    from docloom.plans import catalog

    assert {r.tier for r in catalog.QUERIES["tiered_context"](spark, "/root/testdata/sf0.01").collect()} == {"L0", "L2", "L3"}


def test_few_scores_are_sorted(monkeypatch):
    """Of 20 queries against 8000 vectors, what is sorted after the first slice are the scores that can be among the best."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    v, units = rng.normal(size=(8000, 8)), rng.normal(size=(20, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows, plain = [], np.lexsort
    monkeypatch.setattr(memory.np, "lexsort", lambda keys, **more: rows.append(np.size(keys[0])) or plain(keys, **more))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), pa.array(v.tolist())], names=["item_id", "v"])
    out = next(memory._best(np.arange(20), units, 12)(iter([batch]))).to_pydict()
    scores = np.round(units @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    for q in range(20):
        assert [i for i, k in zip(out["item_id"], out["query_id"]) if k == q] == plain((np.arange(8000), -scores[q]))[:12].tolist()
    assert sum(rows) < 20 * 8000 / 4
