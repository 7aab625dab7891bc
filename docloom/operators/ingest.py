"""Ingest of raw documents into items, sections, chunks, spans and index tasks, as one plan for a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.operators.patterns import key_of, occurrences
from docloom.sources.shared import stored


def outcomes(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Raw documents (path, content) with content_hash and outcome: Skipped if empty or unchanged, Updated if the path has other content, Duplicate if the
    content is stored elsewhere or earlier in this batch, else Inserted. existing: path, content_hash."""
    hashed = raw.withColumn("content_hash", tx.content_hash(F.col("content")))
    known = existing.select("path", F.col("content_hash").alias("old_hash"))
    stored = existing.select("content_hash").distinct().withColumn("stored", F.lit(True))
    joined = hashed.join(known, "path", "left").join(stored, "content_hash", "left")
    first = joined.groupBy("content_hash").agg(F.min("path").alias("first_path"))
    outcome = (
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "Skipped").when(F.col("old_hash") == F.col("content_hash"), "Skipped").when(F.col("old_hash").isNotNull(), "Updated")
        .when(F.col("stored") | (F.col("path") != F.col("first_path")), "Duplicate").otherwise("Inserted")
    )
    return joined.join(first, "content_hash", "left").select("path", "content", "content_hash", outcome.alias("outcome"))


def chunk_tasks(items: DataFrame) -> DataFrame:
    """(item_id, level, priority, idx, section_idx, text): sections as level 1, windows of each section as level 2."""
    each = items.select("item_id", F.explode(tx.sections("content")).alias("s")).select("item_id", "s.section_idx", "s.path", "s.content")
    top = each.select("item_id", F.lit(1).alias("level"), F.lit(1).alias("priority"), F.col("section_idx").alias("idx"), "section_idx", tx.breadcrumb(F.col("path"), F.col("content")).alias("text"))
    low = each.select("item_id", "section_idx", F.posexplode(tx.chunks("content")).alias("idx", "text")).select("item_id", F.lit(2).alias("level"), F.lit(2).alias("priority"), "idx", "section_idx", "text")
    return top.unionByName(low)


def breadcrumbs(items: DataFrame) -> DataFrame:
    """(item_id, section_idx, path, start, end): cumulative character offsets of the sections."""
    each = items.select("item_id", F.explode(tx.sections("content")).alias("s")).select("item_id", "s.section_idx", "s.path", F.length("s.content").alias("n"))
    end = F.sum("n").over(Window.partitionBy("item_id").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", end).select("item_id", "section_idx", "path", (F.col("end") - F.col("n")).alias("start"), "end")


@pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def chunk_spans(texts: pd.Series, chunks: pd.Series) -> pd.Series:
    """Byte span of each chunk, sought from behind the last start, else from the beginning; null if it isn't there."""

    def one(text, pieces):
        out, at = [], 0
        raw = (text or "").encode()
        for p in pieces if pieces is not None else []:
            want = p.strip().encode()
            i = raw.find(want, at)
            i = raw.find(want) if i < 0 else i
            out.append(None if i < 0 or not want else {"start": i, "end": i + len(want)})
            at = i + 1 if i >= 0 else at
        return out

    return pd.Series([one(t, c) for t, c in zip(texts, chunks)])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def sentence_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences with UTF-16 offsets: full-width marks and line ends always end one, ASCII marks only before white space or the end."""
    import re

    pattern = re.compile(r"[^。！？\n]*?(?:[。！？\n]|[.!?](?=\s|$)|$)", re.S)
    size = lambda t: len(t.encode("utf-16-le")) // 2

    def one(text: str) -> list[dict]:
        out, at = [], 0
        for m in pattern.finditer(text or ""):
            n = size(m.group())
            if m.group().strip():
                out.append({"text": m.group(), "start": at, "end": at + n})
            at += n
        return out

    for batch in texts:
        yield batch.map(one)


#: Rules with patterns, or that ask for no keyword, that a routing pass takes: they are broadcast and tried on every message.
MOST_RULES = 10_000


def route(messages: DataFrame, skills: DataFrame) -> DataFrame:
    """(message_id, skill, priority) of the best skill for each message. skills: skill, patterns, keywords, excluded, min_keywords, needs_document, enabled, priority.

    A skill matches by any pattern (a regular expression) or by enough keywords, unless an excluded word occurs. Keywords and excluded words of all rules are looked
    for in one pass over each message; of the rules with patterns or without a needed keyword ``MOST_RULES`` at most may be enabled."""
    rules = skills.where(F.col("enabled") & ~F.exists(F.coalesce("excluded", F.array().cast("array<string>")), lambda w: w == ""))
    rules = rules.withColumn("blank", F.size(F.filter("keywords", lambda k: k == "")))
    is_open = (F.size("patterns") > 0) | (F.col("min_keywords") <= F.greatest("blank", F.lit(0)))
    if rules.where(is_open).limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} enabled rules with patterns")
    texts = messages.select(F.col("message_id").alias("id"), "text")
    words = lambda col: rules.select("skill", F.explode(F.coalesce(col, F.array().cast("array<string>"))).alias("w")).where("w != ''").select("skill", key_of(F.lower("w")).alias("key"))
    wanted = rules.select(F.explode(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("excluded", F.array().cast("array<string>")))).alias("pattern"))
    found = stored(occurrences(texts, wanted, lower=True), "found")
    counted = found.join(words(F.col("keywords")), "key").groupBy("id", "skill").agg(F.count("*").alias("n"))
    by_words = counted.join(rules.select("skill", "min_keywords", "blank"), "skill").where(F.col("n") + F.greatest("blank", F.lit(0)) >= F.col("min_keywords")).select("id", "skill")
    tried = F.broadcast(rules.where(is_open).select("skill", "patterns", "min_keywords", "blank"))
    by_pattern = texts.join(tried, F.exists("patterns", lambda p: F.regexp_like(F.col("text"), p)) | (F.col("min_keywords") <= F.greatest("blank", F.lit(0)))).select("id", "skill")
    barred = found.join(words(F.col("excluded")), "key").select("id", "skill")
    hit = by_words.union(by_pattern).distinct().join(barred, ["id", "skill"], "left_anti")
    ok = hit.join(rules.select("skill", "priority", "needs_document"), "skill").join(messages.select(F.col("message_id").alias("id"), "has_document"), "id")
    best = Window.partitionBy("id").orderBy(F.desc("priority"), "skill")
    ok = ok.where(~F.col("needs_document") | F.col("has_document")).withColumn("r", F.row_number().over(best)).where("r = 1")
    return ok.select(F.col("id").alias("message_id"), "skill", "priority")


def classify_kinds(texts: DataFrame, table: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(id, kind, confidence): table maps a kind to its anchors and keywords. The kind whose anchor occurs wins, else the one with most keywords
    found; confidence is the share of its keywords; ties go to the earlier kind."""
    low = F.lower("text")
    votes = []
    for i, (kind, (anchors, keywords)) in enumerate(table.items()):
        count = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
        votes.append(F.struct((count(anchors) > 0).cast("int").alias("anchored"), count(keywords).alias("hits"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"), (count(keywords) / max(len(keywords), 1)).alias("confidence")))
    best = F.array_max(F.array(*votes))
    return texts.withColumn("b", best).select("id", F.when((F.col("b.anchored") > 0) | (F.col("b.hits") > 0), F.col("b.kind")).alias("kind"), F.round("b.confidence", 6).alias("confidence"))


def evidence_source(results: DataFrame, terms: list[str]) -> DataFrame:
    """(query, item_id) of the source with most evidence: the sum of score + 1 / rank + .35 * shared words, a quarter of it for sources without a
    shared word while others have some."""
    low = F.lower("content")
    overlap = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    each = results.groupBy("query", "item_id").agg(F.sum(F.col("score") + 1 / F.col("rank") + 0.35 * overlap).alias("s"), F.max(overlap).alias("o"))
    some = F.max("o").over(Window.partitionBy("query")) > 0
    final = each.withColumn("s", F.when(some & (F.col("o") == 0), F.col("s") * 0.25).otherwise(F.col("s")))
    return final.groupBy("query").agg(F.max_by("item_id", F.struct("s", -F.col("item_id"))).alias("item_id"))


def cluster_label(titles: DataFrame) -> DataFrame:
    """(cluster, label): the most frequent title word of two characters or more; ties go to the smaller word."""
    words = titles.select("cluster", F.explode(F.array_distinct(tx.tokens(F.col("title")))).alias("w")).where(F.length("w") >= 2)
    counted = words.groupBy("cluster", "w").agg(F.count("*").alias("n"))
    return counted.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("m")).select("cluster", F.col("m.w").alias("label"))


def unify_terms(text: Column, variants: list[tuple[str, str]]) -> Column:
    """Variants replaced by their preferred term, the longest first."""
    out = text
    for variant, preferred in sorted(variants, key=lambda v: (-len(v[0]), v[0])):
        out = F.replace(out, F.lit(variant), F.lit(preferred))
    return out


def summarize_map_reduce(chunks: DataFrame, cache: DataFrame, summarize) -> DataFrame:
    """(item_id, summary): cached chunk summaries, ``summarize`` (a column function) on the misses, joined in chunk order."""
    hashed = chunks.withColumn("chunk_hash", tx.content_hash(F.col("chunk")))
    done = hashed.join(cache.select("chunk_hash", F.col("summary").alias("known")), "chunk_hash", "left").withColumn("part", F.coalesce("known", summarize(F.col("chunk"))))
    return done.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "part"))), lambda s: s["part"]), "\n").alias("summary"))
