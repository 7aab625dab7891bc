"""Many literal patterns in many texts: automata over bounded shards of the patterns, one pass over the texts for each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.skew import meet
from docloom.sources.shared import stored

#: Characters of the patterns of one automaton, at about: what is sent to every task, and some hundred times as many bytes in it.
SHARD_CHARS = 1 << 20


def key_of(pattern: Column) -> Column:
    """What stands for a pattern in joins: 128 bits of it."""
    return F.md5(pattern.cast("binary"))


def occurrences(texts: DataFrame, patterns: DataFrame, lower: bool = False) -> DataFrame:
    """(id, key): which of ``patterns`` (pattern) each of ``texts`` (id, text) contains, once per row of ``texts``; ``key`` as ``key_of``. With ``lower`` both are
    compared in lower case and the key is that of the lower-cased pattern. Null and empty patterns and null texts give nothing.

    A text is read once for all patterns of a shard, in time that doesn't grow with their number. Patterns are cut into shards by hash."""
    body = F.lower("pattern") if lower else F.col("pattern")
    each = stored(patterns.where(F.col("pattern").isNotNull() & (F.col("pattern") != "")).select(body.alias("pattern")).distinct(), "patterns")
    shards = max(math.ceil((each.agg(F.sum(F.length("pattern"))).first()[0] or 0) / SHARD_CHARS), 1)
    held = texts.select("id", "text")
    kind = held.schema["id"].dataType.simpleString()
    out: DataFrame | None = None
    for shard in range(shards):
        rows = each.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard).select("pattern", key_of(F.col("pattern")).alias("key")).collect()
        if not rows:
            continue
        fixed = [(r.pattern, r.key) for r in rows]

        def run(batches: Iterator[pa.RecordBatch], fixed=fixed) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for pattern, key in fixed:
                automaton.add_word(pattern, key)
            automaton.make_automaton()
            for batch in batches:
                at, keys = [], []
                for i, text in enumerate(batch.column(1)):
                    value = text.as_py()
                    if value:
                        found = {key for _, key in automaton.iter(value.lower() if lower else value)}
                        at += [i] * len(found)
                        keys += found
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["id", "key"])

        part = held.mapInArrow(run, f"id {kind}, key string")
        out = part if out is None else out.union(part)
    return held.select("id", F.lit("").alias("key")).limit(0) if out is None else out


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): the rows of ``occurrences`` with the names (key, name) that share a pattern; a pattern that most texts hold is dealt over tasks."""
    found = stored(found, "found")
    sizes = found.groupBy("key").agg(F.count("*").alias("n"))
    keys = stored(names.groupBy("key").agg(F.collect_set("name").alias("names")).join(sizes, "key"), "names")
    return meet(found, keys, "key", F.xxhash64("id")).select("id", F.explode("names").alias("name"))
