"""Memories beside raw results: which tier answers a question, search over live memories, and the context that is put together, for many questions at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.functions.query import query_shape, time_filter
from docloom.sources.shared import stored

# ---- fixed values: memories of a context, candidates for each, the score that displaces raw results, and what memories are called
MEMORIES, OVERFETCH, CONFIDENCE = 3, 4, 0.70
TIERS = {"recall": ("episodic", "L2", "情景记忆"), "overview": ("semantic", "L3", "知识主题记忆")}
#: Questions whose vectors are compared in one pass over the memories.
BLOCK = 1024


def shapes(now: int):
    """Column of a question's struct(shape, start, end): recall with its window, overview or precise."""
    kind = T.StructType([T.StructField("shape", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    @pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            shape = query_shape(t or "", now)
            rows.append((shape, *((time_filter(t or "", now) if shape == "recall" else None) or (None, None))))
        return pd.DataFrame({"shape": [r[0] for r in rows], "start": pd.array([r[1] for r in rows], "Int64"), "end": pd.array([r[2] for r in rows], "Int64")})

    return run


def nearest_many(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, item_id, score, rank): the ``top`` vectors (item_id long, embedding) of each query (query_id long, embedding) by cosine, rounded to 6 digits, ties by id.
    Exact: every vector is compared, with BLOCK queries a pass; a task keeps the best of each. Zero and null vectors, and other sizes than the query's, have no hits."""
    asked = stored(queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")), "asked")
    sizes = sorted(r.n for r in asked.select(F.size("v").alias("n")).distinct().collect() if r.n)
    found = asked.select("query_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score")).limit(0)
    for size in sizes:
        own = asked.where(F.size("v") == size)
        held = vectors.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == size)
        blocks = math.ceil(own.count() / BLOCK)
        for b in range(blocks):
            rows = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            m = np.array([r.v for r in rows], dtype=float).reshape(len(rows), size)
            norms = np.linalg.norm(m, axis=1)
            ids, units = np.array([r.query_id for r in rows])[norms > 1e-8], m[norms > 1e-8] / norms[norms > 1e-8, None]
            if len(ids):
                found = found.union(held.mapInArrow(_best(ids, units, top), "query_id long, item_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


#: Vectors that are compared with a block of queries at once, and first, when every score is sorted.
SLICE, SEED = 1024, 64


def _best(ids: np.ndarray, units: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best so far of each query, in order; only scores that reach the last of them are sorted
        kept = np.full((len(ids), top), -np.inf), np.zeros((len(ids), top), dtype=np.int64)
        single = units.astype(np.float32)
        slack = (units.shape[1] + 16) * 2.0**-23 + 1e-6  # above what single precision and six digits round
        for whole in batches:
            bounds = [0, *range(SEED, whole.num_rows, SLICE), whole.num_rows]
            for batch in (whole.slice(k, m - k) for k, m in zip(bounds, bounds[1:])):
                v = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(v, axis=1)
                fine = norm > 1e-8
                v, items = v[fine] / norm[fine, None], batch.column(0).to_numpy()[fine]
                q, i = np.nonzero(single @ v.astype(np.float32).T >= (kept[0][:, -1] - slack).astype(np.float32)[:, None])
                score = np.concatenate([np.round((units[a] * v[b]).sum(axis=1), 6) for a, b in ((q[k : k + (1 << 16)], i[k : k + (1 << 16)]) for k in range(0, max(len(q), 1), 1 << 16))])
                better = score >= kept[0][q, -1]
                q, i, score = q[better], items[i[better]], score[better]
                some = np.unique(q)
                if not len(some):
                    continue
                q, i, score = np.concatenate([np.repeat(some, top), q]), np.concatenate([kept[1][some].ravel(), i]), np.concatenate([kept[0][some].ravel(), score])
                order = np.lexsort((i, -score, q))
                at = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                first = order[at < top]
                kept[0][some], kept[1][some] = score[first].reshape(-1, top), i[first].reshape(-1, top)
        q, k = np.nonzero(np.isfinite(kept[0]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(kept[1][q, k]), pa.array(kept[0][q, k])], names=["query_id", "item_id", "score"])

    return run


def search_memories(questions: DataFrame, memories: DataFrame, vectors: DataFrame, top: int = MEMORIES) -> DataFrame:
    """(query_id, memory_id, score, rank): live memories of the kind that a question asks for. questions: query_id, embedding, kind, start and end (null: any time).
    memories: memory_id, kind, window_start, window_end, cold, superseded. vectors: item_id (a memory's id), embedding.

    The nearest ``top`` * OVERFETCH of all memories are looked at; cold, superseded and other-kind ones and those outside the question's window fall out of these."""
    near = nearest_many(vectors, questions, top * OVERFETCH).join(questions.select("query_id", F.col("kind").alias("asked"), "start", "end"), "query_id")
    live = memories.where("not cold and not superseded").select("memory_id", "kind", "window_start", "window_end")
    inside = F.col("start").isNull() | ((F.col("window_start") < F.col("end")) & (F.col("window_end") > F.col("start")))
    hits = near.join(live, near.item_id == live.memory_id).where((F.col("kind") == F.col("asked")) & inside)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("query_id", "memory_id", "score", F.col("r").alias("rank"))


def assemble(questions: DataFrame, memories: DataFrame, vectors: DataFrame, results: DataFrame, now: int, confidence: float = CONFIDENCE, enabled: bool = True) -> DataFrame:
    """(query_id, shape, tier, pos, source, id, score, tokens, total): the context of each question, block by block, with estimated tokens of the block and of the whole.

    questions: query_id, text, embedding. results: query_id, rank, item_id, title, content, score (the raw path). memories also have a summary. A recall question asks
    episodic memories of its window, an overview the semantic ones; where the best one reaches ``confidence``, up to three memories and the first raw result are the
    context. Else, for precise questions, and with ``enabled`` off (when every question counts as precise), the raw results are. A question without either has no rows."""
    shaped = questions.withColumn("s", shapes(now)("text"))
    shape = F.col("s.shape") if enabled else F.lit("precise")
    asked = stored(shaped.select("query_id", "embedding", shape.alias("shape"), F.col("s.start").alias("start"), F.col("s.end").alias("end")), "questions")
    pick = lambda i: F.when(F.col("shape") == "recall", TIERS["recall"][i]).when(F.col("shape") == "overview", TIERS["overview"][i])
    wanted = asked.where("shape <> 'precise'").withColumn("kind", pick(0))
    hits = stored(search_memories(wanted, memories, vectors), "hits")
    sure = hits.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= confidence).select("query_id", F.lit(True).alias("sure"))
    tiers = asked.select("query_id", "shape").join(sure, "query_id", "left").withColumn("tier", F.when(F.col("sure"), pick(1)).otherwise("L0")).drop("sure")
    of_memories = hits.join(memories.select("memory_id", "summary"), "memory_id").join(tiers.where("tier <> 'L0'"), "query_id")
    of_memories = of_memories.select("query_id", "shape", "tier", F.col("rank").alias("pos"), F.lit("memory").alias("source"), F.col("memory_id").alias("id"), "score", pick(2).alias("title"), F.col("summary").alias("content"))
    raw = results.join(tiers, "query_id").where((F.col("tier") == "L0") | (F.col("rank") == 1))
    raw = raw.select("query_id", "shape", "tier", F.when(F.col("tier") == "L0", F.col("rank")).otherwise(MEMORIES + 1).alias("pos"), F.lit("item").alias("source"), F.col("item_id").alias("id"), "score", "title", "content")
    count = lambda c: tx.context_tokens(F.coalesce(F.col(c), F.lit("")))
    blocks = of_memories.union(raw).withColumn("tokens", count("title") + count("content"))
    numbered = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "id"))
    out = blocks.withColumn("pos", numbered).withColumn("total", F.sum("tokens").over(Window.partitionBy("query_id")))
    return out.select("query_id", "shape", "tier", "pos", "source", "id", "score", "tokens", "total")
