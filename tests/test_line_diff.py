"""Line diff against the whole table of common subsequences."""

import random
import time
import tracemalloc

import pytest

from docloom.functions import line_diff


def table_diff(x, y):
    """(kind, line) by the suffix table; ties advance x."""
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(("equal", x[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            out.append(("delete", x[i]))
            i += 1
        else:
            out.append(("insert", y[j]))
            j += 1
    return out


@pytest.mark.parametrize("every, letters", [(64, 2), (64, 6), (3, 3), (2, 40)])
def test_matches_the_table(monkeypatch, every, letters):
    monkeypatch.setattr(line_diff, "KEPT_EVERY", every)
    rng = random.Random(letters)
    for _ in range(250):
        x, y = ([f"l{rng.randrange(letters)}" for _ in range(rng.randint(1, 25))] for _ in range(2))
        if rng.random() < 0.5:
            y = [line for line in x if rng.random() < 0.8] or x
        hunks = line_diff.line_hunks("\n".join(x), "\n".join(y))
        assert [(h["kind"], line) for h in hunks for line in h["text"].split("\n")] == table_diff(x, y)
        assert all(a["kind"] != b["kind"] for a, b in zip(hunks, hunks[1:]))


def test_long_texts_with_few_edits():
    rng = random.Random(1)
    x = [f"line {rng.randrange(20_000)}" for _ in range(50_000)]
    y = list(x)
    for _ in range(100):
        y[rng.randrange(len(y))] = "changed"
    tracemalloc.start()
    start = time.time()
    hunks = line_diff.line_hunks("\n".join(x), "\n".join(y))
    took, peak = time.time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and took < 60
    assert "\n".join(h["text"] for h in hunks if h["kind"] != "insert") == "\n".join(x) and "\n".join(h["text"] for h in hunks if h["kind"] != "delete") == "\n".join(y)
    assert sum(h["text"].count("\n") + 1 for h in hunks if h["kind"] == "delete") <= 100


def test_texts_without_a_common_line():
    hunks = line_diff.line_hunks("\n".join(f"a{i}" for i in range(2000)), "\n".join(f"b{i}" for i in range(2000)))
    assert [h["kind"] for h in hunks] == ["delete", "insert"]
    assert line_diff.line_hunks("", "") == [{"kind": "equal", "text": ""}]


def test_turn_diffs_match_the_table(spark):
    """The registered query against the table, turn by turn."""
    from docloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want = {}
    for (c, t), text in texts.items():
        if (c, t - 1) in texts:
            for kind, line in table_diff(texts[c, t - 1].split("\n"), text.split("\n")):
                runs = want.setdefault((c, t), [])
                if runs and runs[-1][0] == kind:
                    runs[-1] = (kind, runs[-1][1] + 1 + len(line))
                else:
                    runs.append((kind, len(line)))
    got = {}
    for r in catalog.QUERIES["turn_diffs"](spark, sf).orderBy("conv_id", "turn", "pos").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.kind, r.n_chars))
    assert got == want
