"""Postings are counted where texts are read, and an index of them answers as a scan does."""

from collections import Counter

import pytest

from docloom.operators import retrieval

TEXTS = [(1, "b a a"), (2, ""), (3, None), (4, "A, b. c-a"), (5, "x " * 9), (6, "dé ÀB 12")]


@pytest.mark.parametrize("piece", [1 << 18, 2])
def test_postings_count_without_a_shuffle(spark, monkeypatch, piece):
    monkeypatch.setattr(retrieval, "PIECE_WORDS", piece)
    frame = spark.createDataFrame(TEXTS, "item_id long, content string")
    got = retrieval.postings(frame)
    want = {(t, i, k, len(w)) for i, w in ((1, ["b", "a", "a"]), (4, ["a", "b", "c", "a"]), (5, ["x"] * 9), (6, ["dé", "àb", "12"])) for t, k in Counter(w).items()}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_one_text(spark):
    frame = spark.createDataFrame([*TEXTS, (1, "a d"), (2, "")], "item_id long, content string")
    got = {tuple(r) for r in retrieval.postings(frame).collect() if r.item_id == 1}
    assert got == {("a", 1, 3, 5), ("b", 1, 1, 5), ("d", 1, 1, 5)}


def test_index_answers_as_a_scan_and_moves_postings_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "PART_ITEMS", 2)
    frame = spark.createDataFrame(TEXTS, "item_id long, content string")
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name, plain=retrieval.stored: kept.append(name) or plain(df, name))
    retrieval.build_index(frame, f"{tmp_path}/index", 4)
    assert kept == ["repeated"]  # neither the postings nor their frequencies are stored on the way
    for terms in (["a"], ["A", "x", "none"], ["none"], []):
        assert retrieval.bm25_indexed(spark, f"{tmp_path}/index", terms, 5).collect() == retrieval.bm25(frame, terms, 5).collect()
