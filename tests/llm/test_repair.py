"""Conversation repair against a search over all edits, and the query against its SQL on rows with nulls and ties."""

import hashlib
import heapq
import random
import re

import duckdb
import pytest

from docloom.llm import queries, repair

WHOLE, BEGUN = re.compile(r"(s?(ua)+)?"), re.compile(r"(s?(ua)*u?)?")


def cheapest(rows):
    """Dijkstra over (cost, audit): rows of (role, text, must go, truncated)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, out, lines = heapq.heappop(heap)
        if i == len(rows) and WHOLE.fullmatch(out):
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if (audit, i, out) in seen:
            continue
        seen.add((audit, i, out))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if BEGUN.fullmatch(out + initial):
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + initial, (*lines, f"{name}:")))
                if i < len(rows) and not rows[i][2]:
                    heapq.heappush(heap, (cost + 2 + rows[i][3], audit + "R", i + 1, out + initial, (*lines, f"{name}:{rows[i][1]}")))
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, lines))
            if not must_go and role and BEGUN.fullmatch(out + role[0]):
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, out + role[0], (*lines, f"{role}:{text}")))


@pytest.mark.parametrize("width", [9, 64])
@pytest.mark.parametrize("roles", [["system", "user", "assistant", "tool", ""], ["system", "assistant"], ["user"], ["system"]])
def test_repair_is_the_cheapest(monkeypatch, width, roles):
    monkeypatch.setattr(repair, "WIDTH", width)
    rng = random.Random(width)
    for _ in range(200):
        rows = [(rng.choice(roles), rng.choice(["a.", "b", "c"]), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 7))]
        it = repair.Repair()
        for role, text, must_go, cut in rows:
            it.row(role.encode(), text.encode(), must_go, cut)
        assert it.done() == cheapest(rows)


def test_weights_stay_short_in_long_conversations():
    it, rng = repair.Repair(), random.Random(3)
    for _ in range(20_000):
        it.row(rng.choice([b"user", b"assistant"]), b"x", rng.random() < 0.1, False)
    assert it.width <= 1024
    cost, audit, _ = it.done()
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) and len(audit) - audit.count("I") == 20_000


def conversations(spark):
    rng = random.Random(8)
    texts = ["Fine.", "no end", " \t\r\n", "", None, "Why?\n", "é!", "end.\x0b", "a. b! c?", "x" * 50_000]
    rows = [(c, rng.choice([*range(8), None, 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "user"]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(700)] + [(1001, 2, "user", "same.")] * 30
    return spark.createDataFrame([(*r, 0, "x", True) for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string, gone boolean")


def test_query_matches_sql(spark, tmp_path):
    rows = conversations(spark)
    rows.repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    frame = queries.op12_conversation_repair(spark, str(tmp_path))
    want = con.sql(queries.OP12_SQL)
    assert sorted(want.columns) == sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*want.columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    assert {r[0] for r in got} == {r.conv_id for r in rows.select("conv_id").distinct().collect()}


def test_damage(spark):
    import zlib

    rows = spark.createDataFrame([(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(10)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in repair.damaged(rows).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    whole = "One. Two! Three?"
    hurt = {0: [("assistant", whole, True)], 1: [("assistant", "", False)], 2: [("assistant", "One Two Three", False)], 3: [("assistant", whole, False)] * 2, 4: [("user", whole, False)]}
    for (c, t), found in got.items():
        assert found == hurt.get(zlib.crc32(f"{c}:{t}".encode()) % 20, [("assistant", whole, False)])


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(repair.damaged(empty)).collect() == []
    gone = spark.createDataFrame([("a", 1, "user", "x.", True), ("b", None, None, None, False)], "conv_id string, turn int, role string, text string, gone boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(gone).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {"a": (0, 0, 0, 0, 0, 0, "", nothing), "b": (0, 1, 0, 0, 0, 3, "D", nothing)}
