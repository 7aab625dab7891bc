"""A stored full-text index in segments: postings by term, and the lengths of items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import analyzer
from docloom.operators.retrieval import bm25_weight, ranked
from docloom.operators.segments import Segments

ANALYZERS: dict[str, tuple[Callable, Callable]] = {
    "plain": (lambda: analyzer.plain_terms, lambda: analyzer.plain_terms),
    "english_han": (analyzer.english_han, lambda: analyzer.english_han(query=True)),
}

#: Words of the texts that are counted at once, at about; it bounds what a task holds.
BATCH_TERMS = 1 << 18
#: The bit of p that marks an item's head.
HEAD = 31
#: Items of one part of a term's postings, at about: a term that all items hold has no more postings than this in one task.
PART_ITEMS = 1 << 18


def length_of(p: str) -> Column:
    return F.shiftright(p, 32).cast("int").alias("length")


def counted(items: DataFrame, how: str) -> DataFrame:
    """(term, item_id, p): each item's terms. p holds the item's number of terms in its high half, then a bit that marks one row of each item, its head, and the term's frequency. Map-only."""
    make = ANALYZERS[how][0]

    def packed(batch: pa.RecordBatch, start: int, lengths: list[int], words: list[str]) -> pa.RecordBatch:
        """The postings of the rows from ``start`` on, whose terms stand in ``words`` one row after the other."""
        flat, sizes = pa.array(words, pa.string()).dictionary_encode(), np.array(lengths, np.int64)
        n = max(len(flat.dictionary), 1)
        keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + flat.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(keys, n)
        p = sizes[row] << 32 | (np.diff(row, prepend=-1) != 0).astype(np.int64) << HEAD | tf
        return pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(start + row)), pa.array(p)], names=["term", "item_id", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = make()
        for batch in batches:
            start, lengths, words = 0, [], []
            for text in batch.column(1):
                found = terms_of(text.as_py() or "")
                lengths.append(len(found))
                words += found
                if len(words) >= BATCH_TERMS:
                    yield packed(batch, start, lengths, words)
                    start, lengths, words = start + len(lengths), [], []
            yield packed(batch, start, lengths, words)

    held = items.select("item_id", "content")
    return held.mapInArrow(run, f"term string, item_id {held.schema['item_id'].dataType.simpleString()}, p long")


class TextIndex(Segments):
    """An index of items (item_id, content) below ``folder``; also in it: ``postings/seq=n``, a segment's rows (see ``counted``) in files sorted by term. Items without a term aren't listed."""

    @classmethod
    def create(cls, spark: SparkSession, folder: str, how: str = "english_han", buckets: int = 64) -> TextIndex:
        """An empty index. ``how`` names its analyzer, ``buckets`` is the least number of tasks that a segment's terms are dealt over."""
        if how not in ANALYZERS:
            raise ValueError(f"no analyzer {how}")
        cls.begin(spark, folder, buckets, how)
        return cls(spark, folder)

    main = "postings"

    def write(self, rows: DataFrame, seq: int) -> tuple[int, int]:
        """Postings are dealt by terms and by parts of the items, so that a frequent term is split over tasks and files. A file is sorted by term alone: the sort then compares
        leading bytes, and a search skips by the terms of row groups and pages. Items are what their heads say."""
        tasks = max(self.setting, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        moved = rows.select("term", "item_id", "p").repartition(tasks, "term", F.pmod(F.xxhash64("item_id"), F.lit(self.parts)))
        moved.sortWithinPartitions("term").write.parquet(f"{self.folder}/postings/seq={seq}")
        written = self.spark.read.schema(f"item_id {rows.schema['item_id'].dataType.simpleString()}, p long").parquet(f"{self.folder}/postings/seq={seq}")
        return super().write(written.where(F.shiftright("p", HEAD) % 2 == 1).select("item_id", length_of("p")), seq)

    def merge(self, most: int = 8) -> None:
        self.parts = max(math.ceil(self.totals()[0] / PART_ITEMS), 1)
        super().merge(most)

    def add(self, items: DataFrame) -> None:
        """Adds items; one that is there already is replaced. Of rows that repeat an id the smallest content stays; null ids aren't indexed."""
        known = items.where(F.col("item_id").isNotNull()).select("item_id", "content")
        again = known.groupBy("item_id").count().where("count > 1").select("item_id")
        if again.limit(1).count():
            one = known.join(again, "item_id", "left_semi").groupBy("item_id").agg(F.min("content").alias("content"))
            known = known.join(again, "item_id", "left_anti").union(one)
        self.parts = max(math.ceil(known.count() / PART_ITEMS), 1)
        self.append(counted(known, self.note), known.select("item_id"))

    def search(self, query: str | list[str], top: int = 10) -> DataFrame:
        """(item_id, score, rank) by BM25 of any of the query's terms: a text goes through the index's analyzer, a list is taken as terms.

        Reads the postings of the query's terms; document frequencies are counted over what is alive in them."""
        terms = sorted(set(ANALYZERS[self.note][1]()(query) if isinstance(query, str) else query))
        docs, length = self.totals()
        if not terms or not docs:
            return self.spark.createDataFrame([], "item_id long, score double, rank int")
        wanted = self.stored("postings", self.segments).where(F.col("term").isin(*terms))
        rows = self.alive(wanted, set(self.segments))
        df = F.broadcast(rows.groupBy("term").agg(F.count("*").alias("df")))
        weight = bm25_weight(F.col("p").bitwiseAND(F.lit((1 << HEAD) - 1)), F.col("df"), length_of("p"), F.lit(docs), F.lit(length / docs))
        return ranked(rows.join(df, "term").groupBy("item_id").agg(F.round(F.sum(weight), 6).alias("score")), top)
