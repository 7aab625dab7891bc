"""Hybrid retrieval: BM25 and vector channels, rank fusion, reranking, penalties and budgets, all as DataFrame plans.

Query-side values (terms, query vector) are small literals; the corpus side is scanned once a channel and reduced to top-k."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.functions.vector import let
from docloom.sources.shared import stored

# ---- fixed values: the model constants of the ranking
K1, B = 1.2, 0.75
RRF_K, VECTOR_WEIGHT, TEXT_WEIGHT = 60, 0.6, 0.4
LANGUAGE_PENALTY, DOMAIN_PENALTY = 0.3, 0.4
RERANK_COSINE, RERANK_RRF = 0.7, 0.3
MIN_SHARE = 100


def bm25_weight(tf: Column, df: Column, length: Column, docs: Column, mean: Column) -> Column:
    """What one term adds to a document's score."""
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


#: Words that are counted at once, at about; it bounds what a task holds.
PIECE_WORDS = 1 << 18
#: Items of one part of a bucket of a stored index, at about: a term that all items hold has no more postings than this in one task.
PART_ITEMS = 1 << 18


def _counted(words: DataFrame) -> DataFrame:
    """(term, item_id, tf, length, head) of rows (item_id, w): the distinct words of each row with their counts; head is 1 in one posting of a row and 0 in the others. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy()
            pieces = (np.cumsum(sizes) - sizes) // PIECE_WORDS
            for start, stop in zip(starts := np.flatnonzero(np.diff(pieces, prepend=-1)), [*starts[1:], batch.num_rows]):
                flat = lists.slice(start, stop - start).flatten().dictionary_encode()
                row, n = np.repeat(np.arange(start, stop), sizes[start:stop]), len(flat.dictionary)
                keys, tf = np.unique(row * n + flat.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(keys, max(n, 1))
                columns = [flat.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(row)), pa.array(tf), pa.array(sizes[row], pa.int32()), pa.array(np.diff(row, prepend=-1) != 0).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "item_id", "tf", "length", "head"])

    return words.mapInArrow(run, f"term string, item_id {words.schema['item_id'].dataType.simpleString()}, tf long, length int, head long")


def _postings(items: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """(term, item_id, tf, length, head), where head adds up to the rows with a word. Rows of an id that comes once are counted where they are read; pairs of item and
    term are shuffled for repeated ids alone, whose rows count as one text."""
    each = lambda rows: _counted(rows.select("item_id", words(F.col("content")).alias("w")).where(F.size("w") > 0))
    again = stored(items.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not again.limit(1).count():
        return each(items)
    same = F.col("item_id").eqNullSafe(F.col("id"))
    several = stored(each(items.join(again, same, "left_semi")), "repeated")
    length = several.groupBy("item_id").agg(F.sum(F.col("length") * F.col("head")).cast("int").alias("length")).withColumnRenamed("item_id", "id")
    one = several.groupBy("term", "item_id").agg(F.sum("tf").alias("tf"), F.sum("head").alias("head"))
    return each(items.join(again, same, "left_anti")).unionByName(one.join(length, same).drop("id"))


def postings(items: DataFrame, words: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """(term, item_id, tf, length): the inverted index, ready to be written bucketed by term. ``words`` makes a text's terms."""
    return _postings(items, words).select("term", "item_id", "tf", "length")


def build_index(items: DataFrame, folder: str, buckets: int = 64) -> None:
    """Writes the inverted index to ``folder``, once for all queries: postings in folders by term bucket and sorted by term, and one row of corpus totals. A query then
    reads the row groups of its terms and no text. Texts are read once and postings move once, dealt by bucket and by parts of the items."""
    parts = max(math.ceil(items.count() / PART_ITEMS), 1)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    moved = _postings(items, tx.tokens).repartition(bucket, F.pmod(F.xxhash64("item_id"), F.lit(parts))).withColumn("bucket", bucket)
    moved.sortWithinPartitions("bucket", "term", "item_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    sums = items.sparkSession.read.schema("tf long, head long, bucket int").parquet(f"{folder}/postings").agg(F.coalesce(F.sum("head"), F.lit(0)).alias("docs"), (F.sum("tf") / F.sum("head")).alias("mean"))
    sums.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/totals")


def bm25_indexed(spark: SparkSession, folder: str, terms: list[str], top: int) -> DataFrame:
    """(item_id, score, rank) of an OR query over an index of ``build_index``: as ``bm25``, from stored postings."""
    wanted = sorted({t.lower() for t in terms})
    totals = spark.read.parquet(f"{folder}/totals").first()
    kind = "term string, item_id long, tf long, length int, head long, bucket int"
    places = [r.b for r in spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(totals.buckets)).cast("int") for t in wanted or [""]])).alias("b")).collect()]
    rows = spark.read.schema(kind).parquet(f"{folder}/postings").where(F.col("bucket").isin(*places) & F.col("term").isin(*wanted))
    df = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))  # one row a term of the query
    weight = bm25_weight(F.col("tf"), F.col("df"), F.col("length"), F.lit(totals.docs), F.lit(totals.mean))
    scored = rows.join(df, "term").groupBy("item_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scored, top)


def bm25(items: DataFrame, terms: list[str], top: int, words: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """(item_id, score, rank) of an OR query without an index. ``words`` makes a text's terms. Texts are tokenized once: what is kept of each, its length and the counts of
    the query's terms, is stored; corpus totals are one aggregate over that, whose single row is broadcast."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return items.select("item_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    words = items.select("item_id", let(words(F.col("content")), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(*wanted)).alias("hits"))).alias("s"))
    count = lambda t: F.size(F.filter("s.hits", lambda x: x == t))
    rows = stored(words.select("item_id", F.col("s.n").alias("n"), *[count(t).alias(f"tf{i}") for i, t in enumerate(wanted)]), "bm25")
    stats = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    hit = F.lit(False)
    total: Column = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.col(f"tf{i}")
        total = total + bm25_weight(tf, F.col(f"df{i}"), F.col("n"), F.col("docs"), F.col("mean"))
        hit = hit | (tf > 0)
    scored = rows.where(hit).join(F.broadcast(stats)).select("item_id", F.round(total, 6).alias("score"))
    return ranked(scored, top)


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The best ``top`` by score, ties by id, numbered from 1; the limit runs per partition before anything is gathered."""
    best = scored.orderBy(F.desc("score"), "item_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")))


def nearest(vectors: DataFrame, query: list[float], top: int, min_cosine: float | None = None) -> DataFrame:
    """(item_id, score, rank): exact nearest by cosine; items with several vectors count with their best one."""
    scored = vectors.select("item_id", F.round(vx.cosine(F.col("embedding"), F.lit(query)), 6).alias("score"))
    if min_cosine is not None:
        scored = scored.where(F.col("score") >= min_cosine)
    return ranked(scored.groupBy("item_id").agg(F.max("score").alias("score")), top)


def fuse(vector: DataFrame, text: DataFrame, top: int, weights: tuple[float, float] = (VECTOR_WEIGHT, TEXT_WEIGHT)) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (item_id, rank)."""
    parts = [c.select("item_id", (w / (RRF_K + F.col("rank"))).alias("s")) for c, w in zip((vector, text), weights)]
    return ranked(parts[0].unionByName(parts[1]).groupBy("item_id").agg(F.round(F.sum("s"), 8).alias("score")), top)


def merge_lists(primary: DataFrame, secondary: DataFrame, limit: int) -> DataFrame:
    """Primary order first, then unseen items of the secondary list."""
    both = primary.select("item_id", "score", "rank", F.lit(0).alias("list")).unionByName(secondary.select("item_id", "score", "rank", F.lit(1).alias("list")))
    once = both.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("list", "rank"))).where("r = 1")
    return once.orderBy("list", "rank").limit(limit).select("item_id", "score", "list", "rank")


def first_per_item(hits: DataFrame) -> DataFrame:
    """Chunk hits (item_id, chunk, score) reduced to the best chunk of each item."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk")
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def rerank(fused: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """0.7 cosine + 0.3 fused score; an item without a vector has cosine 0."""
    cos = vectors.groupBy("item_id").agg(F.max(vx.cosine(F.col("embedding"), F.lit(query))).alias("cos"))
    return fused.join(cos, "item_id", "left").select("item_id", F.round(RERANK_COSINE * F.coalesce("cos", F.lit(0.0)) + RERANK_RRF * F.col("score"), 6).alias("score"))


def penalties(score: Column, query_language: str, doc_language: Column, query_domain: str | None, doc_domain: Column) -> Column:
    """Lowers scores of documents in the other language, or of another special domain."""
    crossed = (doc_language.isin("zh", "en")) & (doc_language != query_language) if query_language in ("zh", "en") else F.lit(False)
    out = F.when(crossed, score * LANGUAGE_PENALTY).otherwise(score)
    return out if query_domain is None else F.when((doc_domain != "general") & (doc_domain != query_domain), out * DOMAIN_PENALTY).otherwise(out)


def coverage_boost(content: Column, terms: list[str]) -> Column:
    """0.45 of the share of query terms found, plus what their lengths weigh, capped."""
    low = F.lower(content)
    found = [F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms]
    weight = sum((f * (4 if any(c.isdigit() for c in t) else 2 if len(t) >= 6 else 1) for f, t in zip(found, terms)), F.lit(0))
    return 0.45 * sum(found, F.lit(0)) / max(len(terms), 1) + F.least(0.05 * weight, F.lit(0.55))


def budget_split(results: DataFrame, budget: int = 2000) -> DataFrame:
    """Characters for each result, in proportion to its score and at least 100; an even split if no score is positive. ``results`` is a
    top-k list, so one window over it is small."""
    total, n = F.sum("score").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    alloc = F.when(total > 0, F.greatest(F.floor(budget * F.col("score") / total), F.lit(MIN_SHARE))).otherwise(F.greatest(F.floor(budget / n), F.lit(MIN_SHARE)))
    return results.withColumn("alloc", alloc.cast("long"))


def feature_score(weights: dict[str, float]) -> Column:
    """Linear bonus model over the columns privacy_allowed, base, exact, entity, domain, lang, citation, vector, bm25_rank, days, level."""
    w = lambda k: weights.get(k, 0.0)
    level = F.when(F.col("level") == 1, 0.45).when(F.col("level") == 2, 1.0).when(F.col("level").isNotNull(), 0.20).otherwise(0.0)
    flags = sum((F.when(F.col(k), w(k)).otherwise(0.0) for k in ("exact", "entity", "domain", "lang", "citation")), F.lit(0.0))
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("vector")))
    score = F.lit(w("base") + w("privacy")) + F.greatest(F.col("base"), F.lit(0.0)) + flags + w("vector") * F.coalesce(clamp, F.lit(0.0))
    score = score + F.coalesce(w("bm25") / F.sqrt(F.col("bm25_rank") + 1), F.lit(0.0)) + F.coalesce(w("recency") / (1 + F.col("days") / 30), F.lit(0.0)) + w("level") * level
    return F.when(F.col("privacy_allowed"), score).otherwise(-1e6)


def pack_history(turns: DataFrame, conversation: str, order: str, cost: Column, budget: int, overhead: int = 8) -> DataFrame:
    """Newest turns of each conversation while their running cost fits; the first that doesn't fit ends it."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("cost", cost + overhead).withColumn("used", F.sum("cost").over(newest)).where(F.col("used") <= budget)


def hit_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Hit@k, recall@k and reciprocal rank of each query: results (query, item_id, rank), relevant (query, item_id)."""
    found = relevant.join(results.where(F.col("rank") <= k), ["query", "item_id"], "left")
    return found.groupBy("query").agg(
        F.max(F.when(F.col("rank").isNotNull(), 1).otherwise(0)).alias("hit"), F.round(F.count("rank") / F.count("*"), 6).alias("recall"),
        F.round(F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)), 6).alias("rr"),
    )


def hybrid(items: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], top: int = 10, initial: int = 50, index: str | None = None) -> DataFrame:
    """The flagship: both channels, fusion, cosine rerank, coverage boost, penalties, top-k and budget. ``index`` is a folder of ``build_index``;
    without one the texts are scanned."""
    lexical = bm25(items, terms, initial) if index is None else bm25_indexed(items.sparkSession, index, terms, initial)
    fused = fuse(nearest(vectors, query, initial), lexical, 2 * top)
    scored = rerank(fused, vectors, query)
    details = items.join(F.broadcast(scored), "item_id")
    language = tx.language(F.col("content"))
    final = penalties(F.col("score") + coverage_boost(F.col("content"), terms), "en", language, None, F.lit("general"))
    return budget_split(ranked(details.select("item_id", F.round(final, 6).alias("score")), top))
