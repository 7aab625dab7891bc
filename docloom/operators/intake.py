"""Intake of signals: checked appends of skill signals, feedback, clicks and page visits, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: kinds of signals and feedback, longest fields
SIGNALS = ["search_miss", "doc_create", "doc_update", "doc_delete", "citation_hit", "annotation_marker", "click_through", "dwell"]
FEEDBACK = ["relevant", "irrelevant", "correction"]
REF_LIMIT, URL_LIMIT, TITLE_LIMIT = 128, 2048, 512


def checked(rows: DataFrame, kind: str, kinds: list[str], ref: str | None = None) -> DataFrame:
    """``rows`` with a problem column: ``kind`` for an unknown or missing kind, ``ref`` for a reference over 128 bytes, else null."""
    problem = F.when(F.coalesce(~F.col(kind).isin(*kinds), F.lit(True)), "kind")
    return rows.withColumn("problem", problem if ref is None else problem.when(F.octet_length(F.col(ref)) > REF_LIMIT, "ref"))


def signals(rows: DataFrame) -> DataFrame:
    """Accepted signals (kind, ref_id, query, ...); the query of one that has none is empty."""
    good = checked(rows, "kind", SIGNALS, "ref_id").where("problem is null").drop("problem")
    return good.withColumn("query", F.coalesce("query", F.lit("")))


def feedback(rows: DataFrame) -> DataFrame:
    """Accepted feedback (item_id, feedback_type, query, ...)."""
    return checked(rows, "feedback_type", FEEDBACK).where("problem is null").drop("problem")


def pending(rows: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Signals that aren't marked as processed; marking is an append of keys to ``processed``."""
    return rows.join(processed.select(key).distinct(), key, "left_anti")


def keyed_hash(value: Column, pepper: str) -> Column:
    """HMAC-SHA256 in hex, of a pepper of at most 64 bytes. The padded pepper stands in the plan: it hides values from a reader of the table,
    not from one of the plan."""
    raw = pepper.encode()
    if len(raw) > 64:
        raise ValueError("a pepper of at most 64 bytes")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0")).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(value, "utf-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def visits(rows: DataFrame, domain: Column, pepper: str) -> DataFrame:
    """Page visits (url, title, ...) as stored: fields cut to their limits, as the store defines them, and the domain as a keyed hash only."""
    cut = {"url": F.substring("url", 1, URL_LIMIT), "title": F.substring("title", 1, TITLE_LIMIT), "domain_hash": keyed_hash(domain, pepper)}
    return rows.withColumns(cut)


def without_domain(stored: DataFrame, domain: str, pepper: str) -> DataFrame:
    """The visits without those of one domain."""
    return stored.where(F.col("domain_hash") != keyed_hash(F.lit(domain), pepper))


def bookmark_counts(bookmarks: DataFrame) -> DataFrame:
    """One row: all bookmark candidates and those that aren't promoted yet."""
    return bookmarks.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("promoted"), F.lit(False))).alias("n_pending"))
