"""Dual-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import ranked_search
from docloom.llm.queries import OP13_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for doc_id, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(n=400):
    rng = random.Random(6)
    common, rare = ["The", "of", "and", "Über", "naïve", "9"], [f"w{i}" for i in range(300)]
    docs = [(i, "".join(rng.choice(common if rng.random() < 0.5 else rare) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(rng.choice([3, 30, 300])))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, "\n-- "), (2003, "w1 " * 20_000), (2004, "ſ K İ")]
    items = [(i, " ".join(rng.choice(common + rare) for _ in range(25))) for i in range(60)]
    items += [(100, docs[7][1]), (101, None), (102, " . "), (103, "nowhere"), (104, "w1"), (105, "w2 w3"), (105, "w4"), (106, "the"), (None, "w5 w6"), (107, " ".join(rare))]
    return docs, items


def test_search_matches_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score int, rank int").repartition(7)
    i = spark.createDataFrame([(*x, "a") for x in items], "item_id long, text string, terms string")
    frame = ranked_search.search(d, i)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, frame.collect()), key=str) == slow(docs, items)
    few = ranked_search.search(d, i, top=3)
    assert sorted(map(tuple, few.collect()), key=str) == slow(docs, items, 3)


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = corpus(120)
    monkeypatch.setattr(ranked_search, "PASS_TERMS", 300)
    frame = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, frame.collect()), key=str) == slow(docs, items)


@pytest.mark.parametrize("sizes", [((16, 8, 2), (32, 8, 4)), ((4, 2, 1), (4, 2, 1))])
def test_trees_of_other_sizes_prune_no_result(monkeypatch, sizes):
    """Trees by hand: all batches of a table against all items, with the leaves that were scored counted."""
    monkeypatch.setattr(ranked_search, "ITEM_NODES", sizes[0])
    monkeypatch.setattr(ranked_search, "DOC_NODES", sizes[1])
    docs, items = corpus(300)
    found = [(i, Counter(terms(t))) for i, t in docs if terms(t) and i is not None]
    wanted = [(i, sorted(set(terms(t)))) for i, t in items if i is not None and i != 105 and terms(t)]
    names = sorted({t for _, ts in wanted for t in ts})
    at = {t: k for k, t in enumerate(names)}
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = np.array([sum(t in c for _, c in found) for t in names])
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    place = np.full(len(names), -1, dtype=np.int64)
    lists = [np.array([at[t] for t in ts]) for _, ts in wanted]
    trees = [ranked_search.ItemTree(np.arange(len(wanted))[k : k + sizes[0][0]], lists[k : k + sizes[0][0]], weight, np.zeros(min(sizes[0][0], len(wanted) - k), dtype=np.int64), 10) for k in range(0, len(wanted), sizes[0][0])]
    looked, leaf = [0], ranked_search.DocTree.leaf
    monkeypatch.setattr(ranked_search.DocTree, "leaf", lambda self, *a: (looked.__setitem__(0, looked[0] + 1), leaf(self, *a))[1])
    ends = np.cumsum([0] + [sum(t in at for t in c) for _, c in found])
    whole = 0
    for a, b in ranked_search.cuts(ends):
        entries = [(at[t], n) for _, c in found[a:b] for t, n in c.items() if t in at]
        length = np.array([sum(c.values()) for _, c in found[a:b]])
        if entries:
            term, tf = (np.array(x) for x in zip(*entries))
            tree = ranked_search.DocTree([i for i, _ in found[a:b]], length, ends[a : b + 1] - ends[a], term, tf, weight, place, n_docs, n_terms)
            whole += len(trees) * -(-(b - a) // sizes[1][-1])
            for t in trees:
                t.meet(tree)
            tree.clear()
    got = {}
    for t in trees:
        for item, score, doc_id in t.results():
            got.setdefault(wanted[item][0], []).append((-score, doc_id))
    want = {}
    for item, _, doc_id, score in slow([(i, t) for i, t in docs if i is not None], [x for x in items if x[0] is not None and x[0] != 105]):
        want.setdefault(item, []).append((-score, doc_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert looked[0] < whole


def test_query_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from docloom.llm import queries

    docs, items = corpus(80)
    docs = [d for d in docs if d[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted(map(tuple, queries.op13_ranked_search(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(OP13_SQL).fetchall(), key=str)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "B"), ("y", None)], "item_id string, text string")
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [("x", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 2"), items)):
        assert ranked_search.search(d, i).collect() == []
