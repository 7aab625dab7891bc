"""Streams: windowed usage, breach streaks with state, indexing and upserts by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.queues import upsert
from docloom.sources.shared import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 8) -> DataFrame:
    """The events table as a stream of files, with the columns id, ts, agent, kind, value."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/events.parque[t]")  # a glob, so that a single file is a source too
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("agent"), F.col("event_type").alias("kind"), "value")


def windowed_usage(events: DataFrame, window: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts, failures and value by event-time window and kind. On a stream ``late`` sets the watermark that closes windows; Spark drops rows
    behind it, so where every row counts leave it out and sum the batches with ``drain_sums``."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    seen = events if late is None else events.withWatermark("ts", late)
    return seen.groupBy(span.alias("w"), "kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("n_failed"), F.sum("value").alias("value"))


def drain_sums(stream: DataFrame, summed: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Runs a stream over all that is there; each micro-batch is reduced by ``summed`` to keys and sums, and the batches' rows are summed. No
    state and no watermark, so rows may come in any order and none is late."""
    folder = drain(stream, "append", reduce=summed)
    out = stream.sparkSession.read.parquet(f"{folder}/out").drop("batch")
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in out.columns if c not in keys])


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Events by agent and session; a session closes when the watermark passes it, and rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent").agg(F.count("*").alias("n"))


def breach_streaks(events: DataFrame, limit: int = 3, late: str = "31 days") -> DataFrame:
    """Per agent the running streak of failures in event order, kept as state between batches; ``disabled`` once it reached the limit.

    Events may come out of order: those of the last ``late`` before an agent's newest one are held in state and put in order before they
    count, which bounds the state; the output runs over them as well. Older ones can't be put in order any more: they count in n and
    n_late and leave the streaks alone."""
    wait = pd.Timedelta(late).value // 1000

    def run(streak: int, longest: int, failed: list) -> tuple[int, int]:
        for f in failed:
            streak = streak + 1 if f else 0
            longest = max(longest, streak)
        return streak, longest

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, longest, n, n_late, closed, *held = state.get if state.exists else (0, 0, 0, 0, -(1 << 62), [], [], [])
        new = [r for b in batches for r in zip(b["us"], b["id"], b["failed"])]
        fresh = [(int(t), int(i), bool(f)) for t, i, f in new if t > closed]
        n, n_late = n + len(new), n_late + len(new) - len(fresh)
        rows = sorted([*zip(*held), *fresh])
        closed = max(closed, rows[-1][0] - wait) if rows else closed
        done = sum(r[0] <= closed for r in rows)
        streak, longest = run(streak, longest, [f for _, _, f in rows[:done]])
        rest = rows[done:]
        state.update((streak, longest, n, n_late, closed, *([r[c] for r in rest] for c in range(3))))
        now, most = run(streak, longest, [f for _, _, f in rest])
        yield pd.DataFrame({"agent": [key[0]], "streak": [now], "longest": [most], "disabled": [most >= limit], "n": [n], "n_late": [n_late]})

    marked = events.select("agent", "id", F.unix_micros("ts").alias("us"), (F.col("kind") == "error").alias("failed"))
    kept = "streak long, longest long, n long, n_late long, closed long, us array<long>, ids array<long>, failed array<boolean>"
    return marked.groupBy("agent").applyInPandasWithState(update, "agent long, streak long, longest long, disabled boolean, n long, n_late long", kept, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, batch: Callable[[DataFrame, int], None] | None = None, reduce: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Runs a stream over all that is there and stops; returns the folder in the shared storage that holds its output and checkpoint.
    ``reduce`` is applied to each micro-batch before it is written."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    # a batch that is tried again overwrites its own folder, so that each counts once
    write = batch or (lambda df, i: (reduce(df) if reduce else df).write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    writer.foreachBatch(write).start().awaitTermination()
    return folder


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last emitted row of each key of an update-mode stream."""
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in (*keys, "batch")]), "batch").alias("s")).select(*keys, "s.*")


def merge_sink(spark: SparkSession, folder: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that keeps a versioned snapshot of the row with the highest ``order`` of each key, whatever the order of arrival: batch
    i reads version i - 1 and writes version i, so a retry is harmless."""

    def merge(changes: DataFrame, i: int) -> None:
        if i == 0:
            out = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), order).alias("s")).select(*keys, "s.*")
        else:
            out = upsert(spark.read.parquet(f"{folder}/version={i - 1}"), changes, keys, order, newest=True)
        out.write.mode("overwrite").parquet(f"{folder}/version={i}")

    return merge
