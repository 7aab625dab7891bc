"""Windows that overlap, against all pairs."""

import random
from collections import Counter

import pytest

from docloom.operators import joins


@pytest.mark.parametrize("part", [3, 4096])
def test_each_overlap_is_found_once(spark, monkeypatch, part):
    """Short, long and empty windows, equal starts and rows that repeat, before and after 0; with buckets in parts and whole."""
    monkeypatch.setattr(joins, "PART_WINDOWS", part, raising=False)
    rng = random.Random(part)
    make = lambda n: [(i, s := rng.randrange(-60, 60), s + rng.choice([0, 1, 7, 30, 200])) for i in range(n)]
    a, b = make(60) + [(99, 5, 9), (99, 5, 9), (98, None, 4)], make(60) + [(99, 5, 9), (97, 5, None)]
    w = lambda rows: spark.createDataFrame(rows, "id long, start long, end long")
    full = lambda rows: [r for r in rows if None not in r and r[1] < r[2]]
    want = Counter(x + y for x in full(a) for y in full(b) if x[1] < y[2] and y[1] < x[2])
    found = joins.overlapping(w(a), w(b), 40)
    assert found.columns == ["a_id", "a_start", "a_end", "b_id", "b_start", "b_end"]
    assert Counter(map(tuple, found.collect())) == want


def test_few_bytes_with_many_pairs_are_dealt_over_tasks(spark):
    """Spark's size rules would make one task of so small an input."""
    w = spark.range(2000).selectExpr("id", "id % 500 as start", "id % 500 + 20 as end")
    found = joins.overlapping(w, w, 40)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert found.count() == 16 * sum(abs(x - y) < 20 for x in range(500) for y in range(500))
