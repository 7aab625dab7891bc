"""Aggregations over usage, signals, tags and memories. Each is one or two hash aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType
from pyspark.sql.window import Window

from docloom.operators import incidence
from docloom.sources.shared import stored


def usage_summary(events: DataFrame, start: int, end: int) -> DataFrame:
    """Global totals of the events in [start, end], both ends included; sums of nothing are 0."""
    inside = events.where(F.col("ts_s").between(start, end))
    return inside.agg(
        F.count("*").alias("n_events"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total_value"), F.count_if(F.col("kind") == "error").alias("n_errors"),
        F.round(F.coalesce(F.sum(F.when(F.col("kind") == "click", F.col("value"))) / F.nullif(F.sum("value"), F.lit(0.0)), F.lit(0.0)), 6).alias("click_share"),
    )


def failure_rates(events: DataFrame, by: list[str]) -> DataFrame:
    """Runs, failures and failure rate of each group whose keys aren't null, highest rate first."""
    known = events.dropna(subset=by)
    rates = known.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(F.col("kind") == "error").alias("n_failed"))
    return rates.withColumn("failure_rate", F.round(F.col("n_failed") / F.col("n_total"), 6)).orderBy(F.desc("failure_rate"), *by)


def popular(events: DataFrame, key: str, limit: int, min_count: int = 1) -> DataFrame:
    """Keys by number of events, most first, ties by key; ``min_count`` makes it the missed-query report."""
    return events.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), key).limit(limit)


def counts_by(frame: DataFrame, key: str) -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def document_frequency(pairs: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Distinct documents of each key."""
    return pairs.groupBy(*keys).agg(F.countDistinct(doc).alias("df"))


def term_frequency(items: DataFrame, terms: Column) -> DataFrame:
    """(term, df): distinct items of each term; ``terms`` makes the distinct terms of a row (item_id, ...). Rows of an id that comes once are counted where they are read;
    pairs of item and term are shuffled for repeated ids alone."""
    known = items.where("item_id is not null")
    again = stored(known.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id"), "repeated")
    each = lambda how: known.join(again, "item_id", how).select("item_id", F.explode(terms).alias("term"))
    return each("left_anti").select("term").union(each("left_semi").distinct().select("term")).groupBy("term").agg(F.count("*").alias("df"))


def item_states(tasks: DataFrame, done: Column, pending: Column, key: str) -> DataFrame:
    """Total, pending and finished tasks of each key in one pass."""
    return tasks.groupBy(key).agg(F.count("*").alias("n_total"), F.count_if(pending).alias("n_pending"), F.count_if(done).alias("n_done"))


def classifier_summary(rows: DataFrame, kind: str, confidence: str, low: float = 0.3) -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(confidence) < low).alias("n_low"), F.round(F.avg(confidence), 6).alias("mean_confidence"))


def term_variants(terms: DataFrame, spelling: str, key: Column) -> DataFrame:
    """Keys with more than one spelling: number of spellings, total occurrences, and the preferred spelling: the most frequent, then the
    smallest. Ordered by total, then key."""
    counted = terms.groupBy(key.alias("term_key"), F.col(spelling).alias("spelling")).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("spelling")))
    out = counted.groupBy("term_key").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("total"), first.alias("p"))
    return out.where("n_spellings > 1").select("term_key", "n_spellings", "total", F.col("p.spelling").alias("preferred")).orderBy(F.desc("total"), "term_key")


def signal_buckets(signals: DataFrame, query: str, ts: str, now: int, window_days: int, min_count: int) -> DataFrame:
    """Recent signals by trimmed lower-case query, with at least ``min_count`` of them, most first."""
    recent = signals.where(F.col(ts) >= now - window_days * 86400)
    pattern = F.lower(F.trim(F.col(query)))
    return recent.where(pattern != "").groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "pattern")


def cooccurrence_expansion(buckets: DataFrame, key: str, tokens: str, weight: str, top: int = 8) -> DataFrame:
    """For each bucket the tokens of other buckets that share a token with it, weighted by how often those occur; the top ones.

    Buckets meet through shared tokens only, and each meeting pair counts once. Buckets of few tokens that many of them hold meet as tiles of a
    matrix (``operators.incidence``)."""
    order = Window.partitionBy("k").orderBy(F.desc("weight"), "token")
    best = lambda scored: scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    if buckets.schema[weight].dataType in (LongType(), IntegerType()):
        rows = stored(buckets.select(F.col(key).alias("id"), F.col(weight).alias("value"), F.array_distinct(tokens).alias("set")), "buckets")
        fit = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("value").alias("values"), F.sum(F.abs(F.col("value").cast("double"))).alias("sum")).first()
        each = rows.select("id", "value", F.explode("set").alias("token"))
        if fit.n == fit.ids == fit.values and (fit.sum or 0) < 1 << 53 and (found := incidence.dense(each)):
            return best(incidence.expansions(each, found))
    each = buckets.select(F.col(key).alias("k"), F.explode(F.array_distinct(tokens)).alias("t"))
    linked = each.alias("a").join(each.alias("b"), "t").where("a.k != b.k").select(F.col("a.k").alias("k"), F.col("b.k").alias("other")).distinct()
    more = linked.join(buckets.select(F.col(key).alias("other"), F.col(weight).alias("w"), F.explode(F.array_distinct(tokens)).alias("token")), "other")
    own = each.select("k", F.col("t").alias("token"))
    scored = more.join(own, ["k", "token"], "left_anti").groupBy("k", "token").agg(F.sum("w").alias("weight"))
    return best(scored)


def cooccurrence_edges(pairs: DataFrame, doc: str, node: str) -> DataFrame:
    """Undirected edges a < b between nodes of one document, weighted by the number of documents."""
    each = pairs.select(doc, node).distinct()
    joined = each.alias("a").join(each.alias("b"), doc).where(F.col(f"a.{node}") < F.col(f"b.{node}"))
    return joined.groupBy(F.col(f"a.{node}").alias("a"), F.col(f"b.{node}").alias("b")).agg(F.count("*").alias("weight"))


def day_buckets(chunks: DataFrame, ts: str, ident: str, min_size: int = 5, take: int = 50, most: int = 4) -> DataFrame:
    """Consolidation bundles: chunks by day, without the last (current) day, days of ``min_size`` chunks or more, the first ``take`` ids
    of each, the ``most`` oldest days."""
    days = chunks.select(F.floor(F.col(ts) / 86400).alias("day"), ident)
    last = days.agg(F.max("day").alias("last"))
    order = Window.partitionBy("day").orderBy(ident)
    # the first ids of a day come from a ranking, so that no task holds all ids of a day in an array
    ranked = days.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("day")))
    kept = ranked.where((F.col("r") <= take) & (F.col("n") >= min_size)).join(F.broadcast(last), F.col("day") < F.col("last"))
    out = kept.groupBy("day").agg(F.max("n").alias("n_chunks"), F.count("*").alias("n_taken"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))
    return out.orderBy("day").limit(most)


def promotion_score(access: Column, days: Column, chunks: Column) -> Column:
    return 1.0 * access + 2.0 / (1 + 0.1 * days) + 0.5 * F.log(F.greatest(chunks, F.lit(1)).cast("double"))


def promotions(memories: DataFrame, min_access: int = 3, min_score: float = 4.0, most: int = 200) -> DataFrame:
    """Memories that pass the access and score gates, best first; ties by creation, first hash, id."""
    score = F.round(promotion_score(F.col("access"), F.col("days"), F.col("n_chunks")), 6)
    return memories.withColumn("score", score).where((F.col("access") >= min_access) & (F.col("score") >= min_score)).orderBy(F.desc("score"), "created_at", "first_hash", "id").limit(most)


def token_bill(rows: DataFrame, actual: str, naive: str) -> DataFrame:
    """Share of tokens saved against sending everything; 0 where nothing would have been sent, never negative."""
    a, n = F.coalesce(F.sum(actual), F.lit(0)), F.coalesce(F.sum(naive), F.lit(0))
    return rows.agg(a.alias("actual"), n.alias("naive"), F.round(F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - a / n)), 6).alias("saved"))


def seed_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.count(value).alias("n"))


def majority_dimension(rows: DataFrame, size: Column) -> DataFrame:
    """Rows with the most frequent size (the larger on a tie) marked clean, the rest as noise."""
    sized = rows.withColumn("dim", size)
    top = sized.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("m")).select(F.col("m.dim").alias("top"))
    return sized.join(F.broadcast(top)).withColumn("clean", F.col("dim") == F.col("top")).drop("top")


def mean_vector(chunks: DataFrame, item: str, vector: str) -> DataFrame:
    """Elementwise mean of each item's vectors."""
    each = chunks.select(item, F.posexplode(vector).alias("i", "x")).groupBy(item, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: F.round(s["x"], 6)).alias("mean"))


def claim_support(claims: DataFrame, key: str, ref: str, pos: str, title: str) -> DataFrame:
    """Claims with the number of distinct references; two or more confirm it. The title is the one seen first."""
    return claims.groupBy(key).agg(F.countDistinct(ref).alias("n_refs"), F.min_by(title, pos).alias("title")).withColumn("confirmed", F.col("n_refs") >= 2)


def dominant(rows: DataFrame, value: str, order: dict[str, int]) -> DataFrame:
    """The most frequent value; ties go to the one that comes first in ``order``."""
    place = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    counted = rows.groupBy(value).agg(F.count("*").alias("n")).withColumn("o", F.coalesce(place[F.col(value)], F.lit(len(order))))
    return counted.orderBy(F.desc("n"), "o", value).limit(1).select(value, "n")
