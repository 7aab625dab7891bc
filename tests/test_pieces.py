"""Text functions answer a batch in bounded pieces, in order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import analyzer, entities, text


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(text, "PIECE", 10)
    monkeypatch.setattr(text, "PIECE_ROWS", 3)
    a, b = pd.Series(["x" * 4, None, "", "y" * 30, "z", "z", "z", "z"]), pd.Series([None, "x" * 6, *["w"] * 6])
    parts = list(text.pieces(a, b))
    assert [len(p) for p, _ in parts] == [2, 2, 3, 1]
    assert pd.concat([p for p, _ in parts]).equals(a) and pd.concat([q for _, q in parts]).equals(b)
    assert [len(p) for (p,) in text.pieces(pd.Series([], dtype=object))] == [0]


@pytest.mark.parametrize("made", [text.chunks.func, text.sections.func, analyzer.analyzed.func, entities.hashed_embedding.func])
def test_output_is_cut_by_size(made):
    """A batch of 1.6 MB comes out as several series, with a row for each of its texts."""
    batch = pd.Series(["some words. " * 8_000, None, ""] * 17)
    out = list(made(iter([batch])))
    assert len(out) > 1 and max(map(len, out)) < len(batch) and sum(map(len, out)) == len(batch)


def test_rows_stay_in_place(spark):
    texts = [(i, f"word{i} " * (i % 50 * 100)) for i in range(300)]
    df = spark.createDataFrame([(i, t, f"line {i}") for i, t in texts], "id int, a string, b string").coalesce(1)
    rows = df.select("id", text.chunks("a").alias("c"), entities.line_diff("a", "b").alias("d"), analyzer.analyzed("a").alias("t"), F.size(entities.hashed_embedding("a")).alias("n")).collect()
    assert len(rows) == 300
    for r in rows:
        want = texts[r.id][1]
        assert r.c == (text.chunk_text(want) if want else []) and r.n == 64
        assert set(r.t) == ({f"word{r.id}"} if want else set()) and len(r.t) == r.id % 50 * 100
        assert [h.text for h in r.d if h.kind == "delete"] == [want]
