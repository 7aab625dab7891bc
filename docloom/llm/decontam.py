"""Benchmark decontamination by spaced seeds: fixed masks ignore some word positions, items' and texts' seeds are joined by hash, and the
overlaps around the hits are verified with substitutions allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import meet, row_key, stored, thinned

#: Words that a mask looks at, at most. An item of n words that may miss s gets s + 1 seeds with no position in common, so that one stays whole
#: whatever the s are; at a similarity of 0.8 there is room for 4 words a seed (3 for 10, 11 and 15 words), and no more.
WEIGHT = 4
#: Distances of a mask's words: 2 is the mask 1010101 and its like, 3 is 1001001001; 1 only for an item with a single seed.
STRIDES = (1, 2, 3)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seed(at, weight: int, stride: int) -> Column:
    """Hash of the words that the mask (weight, stride) looks at; ``at(offset)`` is the hash of the word so far behind the mask's start."""
    return F.xxhash64(F.lit(10 * weight + stride), *[at(stride * j) for j in range(weight)])


def layout(n_seeds: Column, weight: Column) -> Column:
    """array of struct(q, stride): where the masks of an item start. Two seeds of stride 2 interleave and fill 2 * weight words; an odd
    number of seeds begins with three of stride 3."""
    three = F.when(n_seeds == 1, 1).when(n_seeds % 2 == 1, 3).otherwise(0)

    def place(k: Column) -> Column:
        pair = F.floor((k - three) / 2)
        start = F.when(k < three, k).otherwise(three * weight + pair * 2 * weight + F.pmod(k - three, F.lit(2)))
        return F.struct(start.cast("int").alias("q"), F.when(n_seeds == 1, 1).when(k < three, 3).otherwise(2).alias("stride"))

    return F.transform(F.sequence(F.lit(0), n_seeds - 1), place)


def item_seeds(items: DataFrame, min_similarity: float) -> DataFrame:
    """(item_id, weight, stride, q, h): the seeds of each item and where their masks start in it. items: item_id, item (words)."""
    missed = F.size("item") - F.ceil(min_similarity * F.size("item"))
    sized = items.withColumn("seeds", (missed + 1).cast("int")).withColumn("weight", F.least(F.lit(WEIGHT), F.floor(F.size("item") / F.col("seeds"))).cast("int"))
    placed = sized.select("item_id", "weight", F.transform("item", lambda w: F.xxhash64(w)).alias("hashes"), F.explode(layout(F.col("seeds"), F.col("weight"))).alias("s"))
    at = lambda o: F.get("hashes", F.col("s.q") + o)
    h = F.coalesce(*[F.when((F.col("weight") == w) & (F.col("s.stride") == d), seed(at, w, d)) for w in range(1, WEIGHT + 1) for d in STRIDES])
    return placed.select("item_id", "weight", "s.stride", "s.q", h.alias("h"))


def probes(texts: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(key, p, h): the seed of every mask at every word position of every text. texts: key, words."""
    offsets = sorted({d * j for w, d in masks for j in range(w)})
    hashed = texts.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("a"))
    shifted = F.arrays_zip(*[(F.col("a") if not o else F.slice("a", F.lit(o + 1), F.size("a"))).alias(f"w{o}") for o in offsets])
    rows = hashed.select("key", F.posexplode(shifted).alias("p", "s")).select("key", "p", *[F.col(f"s.w{o}").alias(f"w{o}") for o in offsets])
    own = [F.when(F.col(f"w{d * (w - 1)}").isNotNull(), seed(lambda o: F.col(f"w{o}"), w, d)) for w, d in masks]
    return rows.select("key", "p", F.explode(F.array(*own)).alias("h")).where("h is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked pair: doc_id, item_id, start_word (position in the text where the item would begin), n_matched, n_item_words,
    similarity = n_matched / n_item_words, for the best alignment (most matches, then the smallest start).

    Words are runs of letters and digits, lower-cased. A pair counts if any alignment agrees on at least ``min_similarity`` of the
    item's words, position by position; other words may stand at the rest, and no such alignment is missed. Items of fewer than
    ``min_words`` words or a null id aren't looked for. Null and empty texts leak nothing; texts of any length are probed at every word.
    Repeated rows of ``docs`` with equal id and text give one row a pair; repeated items count once. Other columns of both
    tables are ignored, whatever their names.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("item")).where(F.size("item") >= min_words).distinct()
    seeds = stored(item_seeds(items, min_similarity), "seeds")
    masks = sorted((r.weight, r.stride) for r in seeds.select("weight", "stride").distinct().collect()) or [(WEIGHT, 2)]
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = thinned(probes(source.select("key", tokens(F.col("text")).alias("words")), masks), F.col("h"), seeds, "h")
    # a seed of frequent words may stand in most texts: one row a seed holds all its places in items, and a hot seed's probes are dealt over tasks
    found = stored(found, "found")
    places = seeds.groupBy("h").agg(F.collect_set(F.struct("item_id", "q")).alias("at")).join(found.groupBy("h").agg(F.count("*").alias("n")), "h")
    met = meet(found, stored(places, "places"), "h", F.xxhash64("key", "p")).select("key", "p", F.explode("at").alias("at"))
    hits = stored(met.select("key", "at.item_id", (F.col("p") - F.col("at.q")).alias("start_word")).distinct(), "hits")
    # the few texts with a hit are read again, behind a bounded filter, so that no other text is shuffled
    hit = thinned(source, F.col("key"), hits.select("key"), "key").join(hits.select("key").distinct(), "key", "left_semi")
    texts = hit.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("key", "doc_id", tokens(F.col("text")).alias("words"))
    aligned = hits.join(items.select("item_id", "item"), "item_id").join(texts, "key")
    start = F.col("start_word")
    matched = F.size(F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda j: (j + start >= 0) & (F.get("words", F.greatest(j + start, F.lit(0))) == F.get("item", j))))
    counted = aligned.select("key", "doc_id", "item_id", "start_word", matched.alias("n_matched"), F.size("item").alias("n_item_words"))
    good = counted.where(F.col("n_matched") >= min_similarity * F.col("n_item_words"))
    best = F.max(F.struct("n_matched", (-start).alias("early"), "n_item_words")).alias("b")
    return good.groupBy("key", "doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.early")).alias("start_word"), F.col("b.n_matched").alias("n_matched"), F.col("b.n_item_words").alias("n_item_words"),
        (F.col("b.n_matched") / F.col("b.n_item_words")).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns. Rows are compared by a key of id and text, so a null id leaks or stays by its own text. Null and empty
    texts stay, rows alike go or stay together; an empty table, or a benchmark without items, takes nothing away."""
    keyed = docs.select("*", row_key("doc_id", "text").alias("__key"))
    found = leaks(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(found, "__key", "left_anti").drop("__key")
