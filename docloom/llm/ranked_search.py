"""Ranked lexical search by dual trees: a hierarchy of queries meets a hierarchy of documents, and whole pairs of nodes are pruned exactly."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import stored

#: Sizes of the nodes of a level, from the roots to the leaves.
ITEM_NODES, DOC_NODES = (256, 32, 4), (512, 64, 8)
#: Terms that the items of one pass over the documents hold together, at about; it bounds what is on the driver and in a task.
PASS_TERMS = 1 << 20
#: (document, term) entries of one tree of documents; with a document that has more the tree ends.
TREE_ENTRIES = 1 << 17
#: One document in SEED is ranked first, for kth scores to start from; they prune and decide no result.
SEED = 16
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Byte map of the tokenizer: letters in lower case, digits and bytes of other scripts stay, the rest ends a term.
TERMS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]) in LETTERS or 48 <= c <= 57 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters from U+0080 on; only A-Z lower-cased."""
    return text.translate(TERMS).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): distinct terms of each item; rows that share an id make one item, null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(x or b""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    source = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()
    each = source.mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return each.groupBy("item_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def doc_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): length of each document that has a term, and the counts of the terms in ``vocabulary``. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text or b"")
                if not words:
                    continue
                hits = np.array([x for x in map(find, words) if x is not None], dtype=np.int32)
                term, tf = np.unique(hits, return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(term)
                tfs.append(tf)
                ends.append(ends[-1] + len(term))
            flat = lambda parts: pa.array(np.concatenate(parts or [[]]).astype(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat(parts)) for parts in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


def maxima(rows: np.ndarray, size: int, of: int) -> np.ndarray:
    """Coordinate maxima of nodes of ``size`` rows, from nodes of ``of`` rows each."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), max(size // of, 1)), axis=0)


class ItemTree:
    """Up to ITEM_NODES[0] items as sparse weights, with the ``top`` best documents of each so far."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], weight: np.ndarray, least: np.ndarray, top: int) -> None:
        self.ids, self.top, self.least = ids, top, least
        self.row = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        self.term = np.concatenate(terms)
        self.worth = weight[self.term]
        self.best: list[list[tuple]] = [[] for _ in ids]
        # sums below 2**53 are exact in doubles, which multiply faster
        self.kind = np.float64 if max(int(weight[t].sum()) for t in terms) * 10**6 < 1 << 53 else np.int64

    def weights(self, place: np.ndarray, width: int) -> np.ndarray:
        """Items times the columns of a tree of documents; ``place`` is the column of a term, or -1."""
        column = place[self.term]
        out = np.zeros((len(self.ids), width), dtype=self.kind)
        out[self.row[column >= 0], column[column >= 0]] = self.worth[column >= 0]
        return out

    def meet(self, tree: DocTree) -> None:
        """Walks both hierarchies level by level. A pair of nodes goes on if the product of its maxima, which no pair inside exceeds, is positive and
        reaches the weakest kth score among the node's items; equal scores may still win by id."""
        weights = self.weights(tree.place, tree.width)
        alive, bound = np.ones((1, 1), dtype=bool), None
        levels = [maxima(weights, s, 1) for s in ITEM_NODES]
        for k, (item_side, doc_side) in enumerate(zip(levels, tree.levels(self.kind))):
            if k:
                alive = np.repeat(np.repeat(alive, ITEM_NODES[k - 1] // ITEM_NODES[k], axis=0), DOC_NODES[k - 1] // DOC_NODES[k], axis=1)[: len(item_side), : len(doc_side)]
            a, b = alive.any(axis=1), alive.any(axis=0)
            bound = np.zeros(alive.shape, dtype=self.kind)
            bound[np.ix_(a, b)] = item_side[a] @ doc_side[b].T
            weakest = np.minimum.reduceat(self.least, np.arange(0, len(self.least), ITEM_NODES[k]))
            alive &= (bound > 0) & (bound >= weakest[:, None])
            if not alive.any():
                return
        for leaf in np.argsort(-np.where(alive, bound, 0).max(axis=0), kind="stable"):
            # kth scores have risen since the walk: look again
            weakest = np.minimum.reduceat(self.least, np.arange(0, len(self.least), ITEM_NODES[-1]))
            nodes = alive[:, leaf] & (bound[:, leaf] >= weakest)
            if not nodes.any():
                continue
            rows = np.flatnonzero(np.repeat(nodes, ITEM_NODES[-1])[: len(self.ids)])
            docs, columns, values = tree.leaf(leaf, self.kind)
            scores = weights[np.ix_(rows, columns)] @ values.T
            for i, d in zip(*np.nonzero((scores > 0) & (scores >= self.least[rows][:, None]))):
                self.offer(rows[i], int(scores[i, d]), tree.ids[docs[d]])

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        best, entry = self.best[item], (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(best) < self.top:
            heapq.heappush(best, entry)
        else:
            heapq.heappushpop(best, entry)
        if len(best) == self.top:
            self.least[item] = max(self.least[item], best[0][0])

    def results(self) -> Iterator[tuple]:
        for item, best in zip(self.ids, self.best):
            for score, known, negative in best:
                yield int(item), score, -negative if known else None


class DocTree:
    """Up to DOC_NODES[0] documents, those with the same heaviest term side by side, as sparse impacts over the columns of their terms."""

    def __init__(self, ids: list, length: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, place: np.ndarray, n_docs: int, n_terms: int) -> None:
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        m = 10 + (90 * length * n_docs) // n_terms
        impact = (10**9 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((weight[term] * impact, doc))
        heaviest = np.zeros(len(ids), dtype=np.int64)
        heaviest[doc[order]] = term[order]  # the last of a document's entries stays
        rank = np.empty(len(ids), dtype=np.int64)
        by = np.lexsort((length, heaviest))
        rank[by] = np.arange(len(ids))
        self.ids = [ids[i] for i in by]
        self.columns, column = np.unique(term, return_inverse=True)
        self.width, self.place = len(self.columns), place
        place[self.columns] = np.arange(self.width)
        row = rank[doc]
        order = np.argsort(row, kind="stable")
        self.row, self.column, self.impact = row[order], column[order], impact[order]
        self.leaves = np.searchsorted(self.row, np.arange(0, len(ids) + DOC_NODES[-1], DOC_NODES[-1]))

    def levels(self, kind) -> list[np.ndarray]:
        leaves = np.zeros(((len(self.ids) + DOC_NODES[-1] - 1) // DOC_NODES[-1], self.width), dtype=np.int64)
        np.maximum.at(leaves, (self.row // DOC_NODES[-1], self.column), self.impact)
        leaves = leaves.astype(kind)
        return [maxima(leaves, s, DOC_NODES[-1]) for s in DOC_NODES]

    def leaf(self, k: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and impacts (rows times columns) of one leaf."""
        a, b = self.leaves[k], self.leaves[k + 1]
        columns, at = np.unique(self.column[a:b], return_inverse=True)
        docs = np.arange(k * DOC_NODES[-1], min((k + 1) * DOC_NODES[-1], len(self.ids)))
        values = np.zeros((len(docs), len(columns)), dtype=kind)
        values[self.row[a:b] - docs[0], at] = self.impact[a:b]
        return docs, columns, values

    def clear(self) -> None:
        self.place[self.columns] = -1


def cuts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most DOC_NODES[0] documents, and of TREE_ENTRIES entries unless one document has more."""
    at = 0
    while at < len(ends) - 1:
        to = max(int(np.searchsorted(ends, ends[at] + TREE_ENTRIES, side="right")) - 1, at + 1)
        to = min(to, at + DOC_NODES[0], len(ends) - 1)
        yield at, to
        at = to


def ranked(counts: DataFrame, terms: list[np.ndarray], weight: np.ndarray, least: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, doc_id): the best of each task; item is the place in ``terms``. ``least``: scores that the kth can't fall below."""
    heaviest = np.array([t[np.argmax(weight[t])] for t in terms])
    order = np.argsort(heaviest, kind="stable")
    blocks = [order[i : i + ITEM_NODES[0]] for i in range(0, len(order), ITEM_NODES[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ItemTree(ids, [terms[i] for i in ids], weight, least[ids].copy(), top) for ids in blocks]
        place = np.full(len(weight), -1, dtype=np.int64)
        for batch in batches:
            ids, length = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists = batch.column(2), batch.column(3)
            ends = lists[0].offsets.to_numpy().astype(np.int64)
            term, tf = (np.asarray(c.values) for c in lists)
            for at, to in cuts(ends):
                s = slice(ends[at], ends[to])
                if s.stop > s.start:
                    docs = DocTree(ids[at:to], length[at:to], ends[at : to + 1] - ends[at], term[s], tf[s], weight, place, n_docs, n_terms)
                    for tree in trees:
                        tree.meet(docs)
                    docs.clear()
        rows = [r for tree in trees for r in tree.results()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], names=["item", "score", "doc_id"])

    found = counts.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, score long, doc_id long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a positive score, equal scores by ascending id.

    A score sums w * ((10**9 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms; w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L
    over all documents (N with a term, L terms in them, n in one). Integers throughout, so any order of summing gives the same.

    Texts are read once a pass and reduced to the counts of the pass's item terms; a pass takes the items of about PASS_TERMS terms, so nothing that
    grows with either table is held whole. Each task then builds trees of its documents and walks them against the trees of the items; kth scores
    of one document in SEED are where pruning starts. What leaves a task is at most ``top`` rows an item.

    Null and empty texts, and texts without a term, rank nowhere; items without a term get no rows. Repeated rows of ``docs`` rank once each; a null id comes
    after the others of its score. Rows of ``items`` that share an id are one item with the terms of all. Other columns of both tables are ignored.
    An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    named = stored(item_terms(items, item_col, item_text), "items")
    passes = max(math.ceil((named.agg(F.sum(F.size("terms"))).first()[0] or 0) / PASS_TERMS), 1)
    out = named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    for k in range(passes):
        rows = named.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id").collect()
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        terms = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms], dtype=np.int64) for r in rows]
        counts = stored(doc_counts(docs, vocabulary, id_col, text_col), "counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the pass at most
            df[r.t] = r["count"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        least = np.zeros(len(rows), dtype=np.int64)
        seed = counts.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
        for r in ranked(seed, terms, weight, least, n_docs, n_terms, top).where(F.col("rank") == top).select("item", "score").collect():
            least[r.item] = r.score
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {named.schema['item_id'].dataType.simpleString()}")
        best = ranked(counts, terms, weight, least, n_docs, n_terms, top).join(F.broadcast(ids), "item")
        out = out.union(best.select("item_id", "rank", "doc_id", "score"))
    return out
