"""Upkeep of stored vectors and indexes: model fingerprints, stale vectors, re-indexing of changed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ingest import chunk_tasks


def _known(fingerprint: Column) -> Column:
    return F.when(F.trim(fingerprint) != "", F.trim(fingerprint))


def compatibility(vectors: DataFrame, index: str, fingerprint: str, current: str | None, enforce: bool = True) -> DataFrame:
    """One row per index and stored fingerprint: n, status (match, mismatch, unknown, current_unknown), usable, stale. Only a proven mismatch
    makes vectors stale, and only if ``enforce``; a null or blank fingerprint is unknown."""
    now = _known(F.lit(current).cast("string"))
    stored = vectors.groupBy(index, _known(F.col(fingerprint)).alias(fingerprint)).agg(F.count("*").alias("n"))
    status = F.when(now.isNull() & F.col(fingerprint).isNotNull(), "current_unknown").when(now.isNull() | F.col(fingerprint).isNull(), "unknown").when(F.col(fingerprint) == now, "match").otherwise("mismatch")
    usable = (F.col("status") != "mismatch") | F.lit(not enforce)
    return stored.withColumn("status", status).withColumn("usable", usable).withColumn("stale", F.when(usable, 0).otherwise(F.col("n")))


def usable_vectors(vectors: DataFrame, fingerprint: str, current: str | None) -> DataFrame:
    """The vectors without a proven mismatch: a filter that reaches the scan where the fingerprint is a partition column."""
    now, stored = _known(F.lit(current).cast("string")), _known(F.col(fingerprint))
    return vectors.where(now.isNull() | stored.isNull() | (stored == now))


def stale_ids(vectors: DataFrame, item: str, model: str, current: str) -> DataFrame:
    """Items with a vector of another model, once each with the models to migrate from."""
    return vectors.where(F.col(model) != current).groupBy(item).agg(F.sort_array(F.collect_set(model)).alias("from_models"))


def migration(vectors: DataFrame, model: str, current: str) -> DataFrame:
    """Progress of a re-embedding: one row per model with its vectors and whether they are done."""
    return vectors.groupBy(F.col(model).alias("from_model")).agg(F.count("*").alias("n")).withColumn("done", F.col("from_model") == current)


def reindex(items: DataFrame, changed: DataFrame, vectors: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors kept, queue kept, new chunk tasks) after the items of ``changed`` (item_id) are purged from vectors and queue and cut anew."""
    ids = changed.select("item_id").distinct()
    again = chunk_tasks(items.join(ids, "item_id", "left_semi"))
    return vectors.join(ids, "item_id", "left_anti"), queue.join(ids, "item_id", "left_anti"), again


def roll_up(gates: DataFrame) -> DataFrame:
    """Quality gates (tier, plugin, external, ignored, ci) counted by tier, by plugin and in all: dim, val, n, n_external, n_ignored, n_nightly."""
    dims = F.explode(F.array(F.struct(F.lit("tier").alias("dim"), F.col("tier").alias("val")), F.struct(F.lit("plugin").alias("dim"), F.col("plugin").alias("val")), F.struct(F.lit("all").alias("dim"), F.lit("").alias("val"))))
    each = gates.select(dims.alias("d"), "external", "ignored", "ci")
    counts = [F.count("*").alias("n"), F.count_if("external").alias("n_external"), F.count_if("ignored").alias("n_ignored"), F.count_if(F.col("ci") == "nightly").alias("n_nightly")]
    return each.groupBy("d.dim", "d.val").agg(*counts)


def ignore_spikes(observed: DataFrame, baseline: DataFrame, key: str, allowed: int = 2) -> DataFrame:
    """Keys with more ignored tests than their baseline (0 without one) allows: key, observed, baseline, spiked."""
    joined = observed.select(key, "observed").join(baseline.select(key, "baseline"), key, "left").fillna(0, ["baseline"])
    return joined.withColumn("spiked", F.col("observed") > F.col("baseline") + allowed)
