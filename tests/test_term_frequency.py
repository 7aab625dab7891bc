"""Document frequencies, with and without repeated ids."""

from pyspark.sql import functions as F

from docloom.operators import rollups


def test_repeated_ids_count_once(spark):
    rows = [(1, "a b"), (2, "b c"), (2, "b d"), (3, None), (None, "a"), (4, "b")]
    items = spark.createDataFrame(rows, "item_id long, content string").repartition(3)
    got = rollups.term_frequency(items, F.array_distinct(F.split("content", " ")))
    assert {r.term: r.df for r in got.collect()} == {"a": 1, "b": 3, "c": 1, "d": 1}


def test_single_ids_shuffle_terms_alone(spark):
    """The shuffled rows of ids that come once are one a term and task, not one a term and item."""
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("x y z").alias("content")).coalesce(2)
    plan = rollups.term_frequency(items, F.array_distinct(F.split("content", " ")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "distinct item_id" not in plan
