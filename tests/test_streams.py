"""The stream queries over one file and over many shuffled files: equal results, whatever the order of arrival."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import queues
from docloom.plans import catalog
from docloom.streaming import usage


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(seconds=rng.randrange(29 * 86_400)), rng.randrange(12), rng.choice(["view", "error", "error", "click"]), rng.randrange(100) / 4, '{"k": 1}') for i in range(2000)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    one, many = str(tmp_path_factory.mktemp("one")), str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{one}/events.parquet")
    rng.shuffle(events)
    spark.createDataFrame(events, schema).withColumn("f", F.col("event_id") * 7919 % 20).repartitionByRange(20, "f").drop("f").write.parquet(f"{many}/events.parquet")
    return one, many


@pytest.mark.parametrize("name", ["stream_daily_usage", "stream_breach_streaks", "stream_upserts"])
def test_order_of_arrival_does_not_matter(spark, folders, name):
    one, many = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in folders)
    assert one == many and len(one) >= 12
    if name == "stream_daily_usage":
        assert sum(r[2] for r in one) == 2000


def test_events_behind_the_buffer_are_counted(spark, folders):
    rows = usage.latest(spark, usage.drain(usage.breach_streaks(usage.event_stream(spark, folders[1], 2), late="1 hour"), "update"), ["agent"]).collect()
    assert sum(r.n for r in rows) == 2000 and sum(r.n_late for r in rows) > 0


def test_upsert_by_order(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5)], "k long, v string, o long")
    changes = spark.createDataFrame([(1, "old", 4), (2, "new", 6), (2, "newer", 7), (4, "first", 1)], "k long, v string, o long")
    rows = lambda **o: {tuple(r) for r in queues.upsert(base, changes, ["k"], "o", **o).collect()}
    assert rows(newest=True) == {(1, "a", 5), (2, "newer", 7), (3, "c", 5), (4, "first", 1)}
    assert rows() == {(1, "old", 4), (2, "newer", 7), (3, "c", 5), (4, "first", 1)}
