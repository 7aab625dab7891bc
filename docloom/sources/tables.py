"""Readers of the stored tables, with the column names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: item_id, content, lang, source_type."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), "lang", F.col("source").alias("source_type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of doubles: item_id, embedding, domain."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("domain"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records: id, ts_s (epoch seconds), agent, kind, value, item (the k of the JSON properties)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), F.col("user_id").alias("agent"),
        F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("item"),
    )
