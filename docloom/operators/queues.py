"""Work queues, retries, streaks, upserts and admission as batch operators over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longest wait between two tries, in milliseconds.
LONGEST_WAIT = 3_600_000


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Jobs ahead of each queued job: higher priority first, then earlier creation, then id. jobs: id, priority, created.

    Jobs ahead are counted by priority class (a small broadcast total) plus the rank inside the class by creation day, so that no
    window spans the whole queue."""
    day = F.floor(F.col("created") / 86_400_000)
    queued = jobs.withColumn("day", day)
    sizes = queued.groupBy("priority", "day").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("priority"), "day").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("priority", "day").orderBy("created", "id")
    ranked = queued.withColumn("r", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["priority", "day"]).select("id", (F.col("start") + F.col("r")).alias("position"))


def ready(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where((F.col("state") == "queued") & (F.coalesce("next_attempt", F.lit(0)) <= now))


def claimed(jobs: DataFrame, now: int, most: int, lease: int, worker: str) -> DataFrame:
    """The rows that a claim changes: the ``most`` first ready jobs, by priority, creation and id, now running under ``worker`` until ``deadline`` = now + lease. Merged
    back by id (``upsert`` with ``claimed_at``) they are the queue after the claim; a later claim over that doesn't see them until ``swept`` returns those whose lease ran out.
    jobs: id, priority, created, state, next_attempt, deadline, worker, claimed_at. Only the best of each task meet."""
    first = ready(jobs, now).orderBy(F.desc("priority"), "created", "id").limit(most)
    lit = lambda v, c: F.lit(v).cast(jobs.schema[c].dataType).alias(c)
    new = {"state": "running", "deadline": now + lease, "worker": worker, "claimed_at": now}
    return first.select(*[lit(new[c], c) if c in new else F.col(c) for c in jobs.columns])


def backoff(base: Column, attempts: Column) -> Column:
    """base * 2 ** (attempts - 1) milliseconds, one hour at most."""
    return F.least(base * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(40))), F.lit(float(LONGEST_WAIT))).cast("long")


def after_failure(jobs: DataFrame, now: int, base: int, most: int, retryable: list[str]) -> DataFrame:
    """Failed jobs go back to the queue with a later next_attempt while their code may be retried and attempts are left; else abandoned."""
    again = F.col("error_code").isin(*retryable) & (F.col("attempts") + 1 < most)
    wait = backoff(F.lit(base), F.col("attempts") + 1)
    return jobs.select("id", (F.col("attempts") + 1).alias("attempts"), F.when(again, "queued").otherwise("abandoned").alias("state"), F.when(again, now + wait).alias("next_attempt"))


def swept(jobs: DataFrame, now: int, at_least_once: bool) -> DataFrame:
    """Running jobs past their deadline: queued again or failed, by the delivery guarantee."""
    late = (F.col("state") == "running") & (F.col("deadline") < now)
    return jobs.withColumn("state", F.when(late, "queued" if at_least_once else "failed").otherwise(F.col("state")))


def streaks(periods: DataFrame, key: list[str], order: str, breach: Column, limit: int = 3) -> DataFrame:
    """Length of the current run of breaches of each key at each period; a recovery starts again from 0. ``disable`` from ``limit`` on."""
    w = Window.partitionBy(*key).orderBy(order)
    runs = periods.withColumn("b", breach).withColumn("island", F.sum(F.when(F.col("b"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*key, "island").orderBy(order)
    streak = F.sum(F.when(F.col("b"), 1).otherwise(0)).over(inside)
    return runs.withColumn("streak", streak).withColumn("disable", F.col("streak") >= limit).drop("island", "b")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str, sticky: list[str] | None = None, newest: bool = False) -> DataFrame:
    """``base`` with the row of the highest ``order`` of each key from ``changes``; ``sticky`` columns keep the value the base has.

    The last write wins: a change beats the base. With ``newest`` it does so only if its ``order`` isn't lower, so that changes may come late."""
    fields = [c for c in base.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("n"))
    joined = base.alias("b").join(latest, keys, "full_outer")
    wins = F.col("n").isNotNull()
    if newest:
        wins = wins & F.coalesce(F.col(f"n.{order}") >= F.col(f"b.{order}"), F.lit(True))
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"n.{c}")) if c in (sticky or []) else F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in fields])


def retained(frame: DataFrame, ts: str, cutoff: int, extra: Column | None = None) -> DataFrame:
    """Rows that a purge leaves: newer than the cutoff, or not matching the extra condition."""
    old = F.col(ts) < cutoff
    return frame.where(~F.coalesce(old & extra if extra is not None else old, F.lit(False)))


def keep_newest(frame: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    return frame.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def admission(tokens: Column, sync_limit: int, async_limit: int, blocked: Column, overflow: str = "reject") -> Column:
    """reject for nothing, the overflow decision beyond the async limit, async beyond the sync limit or if blocked, else sync."""
    return F.when(tokens <= 0, "reject").when(tokens > async_limit, overflow).when((tokens > sync_limit) | blocked, "async").otherwise("sync")
