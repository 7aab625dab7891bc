"""Automata against plain containment, routing against plain rules, and the plans that must hold no product."""

import random
import re

import pytest

from docloom.operators import ingest, joins, patterns


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_occurrences_match_containment(spark, monkeypatch, lower, chars):
    monkeypatch.setattr(patterns, "SHARD_CHARS", chars)
    rng = random.Random(chars)
    words = ["a", "ab", "b", "Ab", "é", "中文", " ", "x\n"]
    make = lambda n: "".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    texts = [(i, make(30)) for i in range(60)] + [(100, None), (101, ""), (7, "ab"), (102, "b" * 50_000 + "é")]
    bodies = sorted({make(4) for _ in range(40)}) + [None, "", "ab", "ab", "b" * 300]
    names = spark.createDataFrame([(b,) for b in bodies], "pattern string")
    found = patterns.occurrences(spark.createDataFrame(texts, "id long, text string"), names, lower=lower)
    keys = {r.k: r.p for r in names.where("pattern <> ''").selectExpr(f"md5(cast({'lower(pattern)' if lower else 'pattern'} as binary)) k", f"{'lower(pattern)' if lower else 'pattern'} p").collect()}
    fold = (lambda t: t.lower()) if lower else (lambda t: t)
    want = sorted((i, b) for i, t in texts if t for b in {fold(b) for b in bodies if b} if b in fold(t))
    assert sorted((r.id, keys[r.key]) for r in found.collect()) == want


def test_no_product_in_the_plan(spark):
    rows = spark.range(50).selectExpr("id as item_id", "concat('text of ', id, ' and two') as content")
    refs = spark.createDataFrame([(i, f"of {i}") for i in range(30)] + [(90, "two"), (91, "two"), (92, " ")], "ref_id long, body string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", keep):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            frame = joins.explicit_references(rows, refs)
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
            got = {(r.item_id, r.ref_id) for r in frame.collect()}
            assert got == {(i, r) for i in range(50) for r, b in [(k, f"of {k}") for k in range(30)] + [(90, "two"), (91, "two")] if b in f"text of {i} and two"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def plain_route(messages, rules):
    out = set()
    for i, text, document in messages:
        best = []
        for name, expressions, keywords, excluded, least, needs, enabled, priority in rules:
            low = None if text is None else text.lower()
            held = lambda ws: [w for w in ws if low is not None and w.lower() in low]  # noqa: B023, E731
            if enabled and not held(excluded) and (document or not needs):
                if text is not None and any(re.search(p, text) for p in expressions) or len(held(keywords)) >= least:
                    best.append((-priority, name))
        if best:
            out.add((i, min(best)[1], -min(best)[0]))
    return out


SHAPE = "skill string, patterns array<string>, keywords array<string>, excluded array<string>, min_keywords int, needs_document boolean, enabled boolean, priority int"


def test_routes_match_plain_rules(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Total", "é"]
    pick = lambda n: [rng.choice(words) for _ in range(rng.randint(0, n))]
    rules = [(f"s{i}", [rng.choice(words)] if i % 5 == 0 else [], pick(4), pick(1), rng.randint(0 if i % 17 == 0 else 1, 2), rng.random() < 0.3, rng.random() < 0.9, rng.randint(0, 9)) for i in range(60)]
    messages = [(i, " ".join(pick(8)), rng.random() < 0.5) for i in range(80)] + [(200, None, True), (201, "", False)]
    got = {tuple(r) for r in ingest.route(spark.createDataFrame(messages, "message_id long, text string, has_document boolean"), spark.createDataFrame(rules, SHAPE)).collect()}
    assert got == plain_route(messages, rules)


def test_ten_thousand_rules_are_one_pass(spark):
    rules = [(f"s{i:05}", [], [f"word{i}x", "always"], [], 2, False, True, i) for i in range(12_000)]
    messages = spark.createDataFrame([(i, f"always word{7 * i}x and word{11 * i}x", False) for i in range(50)], "message_id long, text string, has_document boolean")
    frame = ingest.route(messages, spark.createDataFrame(rules, SHAPE))
    assert {(r.message_id, r.priority) for r in frame.collect()} == {(i, 11 * i) for i in range(50)}
