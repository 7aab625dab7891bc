"""Text reduction: extractive sentences, chunk compression behind a cache, line diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def extract_top(sentences: DataFrame, key: str, pos: str, text: str, score: Column, ratio: float) -> DataFrame:
    """The best ceil(ratio * n) sentences of each key in their own order; the ratio is held between 0.05 and 1."""
    ratio = min(max(ratio, 0.05), 1.0)
    best = Window.partitionBy(key).orderBy(F.desc("__score"), pos)
    ranked = sentences.withColumn("__score", score).withColumn("__n", F.count("*").over(Window.partitionBy(key))).withColumn("__r", F.row_number().over(best))
    kept = ranked.where(F.col("__r") <= F.ceil(ratio * F.col("__n")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return kept.groupBy(key).agg(F.count("*").alias("n_kept"), F.array_join(F.transform(parts, lambda s: s["t"]), "").alias("summary"))


def compress_chunks(chunks: DataFrame, cache: DataFrame, strategy: str, limit: int, summarize=None) -> DataFrame:
    """Chunks with their compressed text: short ones as they are, cached ones by (hash, strategy), the rest by ``summarize`` (a column
    function) or cut to ``limit`` characters."""
    hashed = chunks.withColumn("chunk_hash", F.sha2(F.col("chunk").cast("binary"), 256))
    known = cache.where(F.col("strategy") == strategy).select("chunk_hash", "summary")
    fresh = summarize(F.col("chunk")) if summarize else F.substring("chunk", 1, limit)
    out = F.when(F.length("chunk") <= limit, F.col("chunk")).otherwise(F.coalesce("summary", fresh))
    return hashed.join(known, "chunk_hash", "left").withColumn("cached", F.col("summary").isNotNull()).withColumn("compressed", out).drop("summary")
