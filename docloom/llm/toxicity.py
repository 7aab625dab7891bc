"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored
from docloom.llm.textstats import class_counts, fold, labelled_sample

#: Words: runs of characters other than ASCII and Latin-1 characters that aren't letters, and general and CJK punctuation, in lower-case text.
TERM = re.compile("[^\x00-`{-\xbf\xd7\xf7\u2000-\u206f\u3000-\u303f]+")
#: Examples of one block of the index.
BLOCK = 32
#: Lengths of the word beginnings that count as terms too, for languages that inflect and compound.
STEMS = (4, 5, 6)
#: The term of all words that have no term of their own, and its weight, that of a term found in every text.
OTHER, OTHER_WEIGHT = "", 1.0
#: Cosines that differ by less count as equal.
TIE = 1e-6
#: Texts that one numpy step searches at once.
CHUNK = 256
#: Texts that one task searches, where these come without their text.
TASK_TEXTS = 10_000


def words(text: str) -> list[str]:
    return TERM.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """The terms of one word: itself, and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Terms:
    """Numbers of the chosen terms. Words without one are remembered, so that a set difference tells most words of a text."""

    def __init__(self, chosen: list[str]):
        self.number = {t: i for i, t in enumerate(sorted({OTHER, *chosen} if chosen else ()))}
        self.known: dict[str, list[int]] = {}
        self.plain: set[str] = set()

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "plain": set()}

    def look_up(self, new: list[str]) -> None:
        number = self.number
        for word in new:
            if found := [number[x] for x in terms_of(word) if x in number]:
                self.known[word] = found
            else:
                self.plain.add(word)

    def forget(self, most: int = 0) -> None:
        if len(self.known) + len(self.plain) > most:
            self.known.clear()
            self.plain.clear()

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences by term number. Words without a term count together as OTHER, so that a few marked words weigh less in a long text."""
        if not self.number:
            return {}
        out: dict[int, int] = {}
        self.forget(200_000)
        every = words(text)
        left = set(every) - self.plain
        self.look_up([w for w in left if w not in self.known])
        left = [w for w in left if w in self.known]
        other = len(every)
        number = Counter(every) if len(left) > 6 else {w: every.count(w) for w in left}
        for word in left:
            n = number[word]
            other -= n
            for t in self.known[word]:
                out[t] = out.get(t, 0) + n
        if other:
            out[self.number[OTHER]] = other
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each (start, size), one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Index:
    """Inverted index over the labelled examples. Postings (cols, weights) lie in (term, example) order; those of term t in block b are
    cut[t, b] to cut[t, b + 1]. ``block_max[t, b]`` is the highest weight of term t in block b and bounds what the block can score."""

    terms: Terms
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    cols: np.ndarray
    weights: np.ndarray
    cut: np.ndarray
    block_max: np.ndarray
    #: blocks met, and blocks whose postings were walked
    met: int = 0
    walked: int = 0

    def unit(self, rows: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF weights of (text, term, occurrences) entries, of unit length by text."""
        w = (1 + np.log(n)) * self.idf[t]
        return w / np.sqrt(np.bincount(rows, w * w))[rows] if len(w) else w

    def nearest(self, starts: np.ndarray, t: np.ndarray, n: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine): for each text the k nearest examples, without its ``skip``, and all that tie with the k-th; by text, highest
        cosine first, lower example on a tie; only cosines above 0. The terms of text i are t[starts[i]:starts[i + 1]].

        Of each text the blocks of the highest bounds are read first; then those whose bound reaches the k-th cosine so far, so the
        answer is exact. The skipped example is out before the k-th cosine is taken."""
        texts, examples, blocks = len(starts) - 1, len(self.ids), self.block_max.shape[-1]
        if not examples or not len(t):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        size = np.diff(starts)
        rows = np.repeat(np.arange(texts), size)
        w = self.unit(rows, t, n)
        bounds = np.zeros((texts, blocks))
        bounds[size > 0] = np.add.reduceat(w[:, None] * self.block_max[t], starts[:-1][size > 0], axis=0)
        scores = np.zeros((texts, examples))

        def walk(r: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Adds the cosines of text r with the examples of block b, from the postings; returns the k-th cosine of each text."""
            entry = spread(starts[r], size[r])
            block = np.repeat(b, size[r])
            low = self.cut[t[entry], block]
            many = self.cut[t[entry], block + 1] - low
            at = spread(low, many)
            place = np.repeat(rows[entry] * examples, many) + self.cols[at]
            scores.ravel()[:] += np.bincount(place, np.repeat(w[entry], many) * self.weights[at], texts * examples)
            self.walked += len(r)
            if skip is not None:
                scores[np.arange(texts), skip] = 0
            return np.partition(scores, examples - k, axis=1)[:, examples - k] if examples > k else np.zeros(texts)

        first = np.argsort(-bounds, axis=1, kind="stable")[:, : min(blocks, -(-(k + 1) // BLOCK) + 1)]
        kth = walk(np.repeat(np.arange(texts), first.shape[1]), first.ravel())
        need = bounds >= np.maximum(kth - 2 * TIE, TIE)[:, None]
        np.put_along_axis(need, first, False, 1)
        kth = walk(*np.nonzero(need))
        self.met += texts * blocks
        scores = np.round(scores, 6)
        text, ex = np.nonzero(scores >= np.maximum(np.round(kth, 6), TIE)[:, None])
        cosine = scores[text, ex]
        by = np.lexsort((ex, -cosine, text))
        return text[by], ex[by], cosine[by]


@dataclass(frozen=True)
class Votes:
    """Turns neighbours into a calibrated score: a logistic curve over the distance-weighted vote and the gap of the best cosines."""

    prior: float
    curve: tuple[float, float, float]

    @staticmethod
    def features(texts: int, text: np.ndarray, labels: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Rows (1, vote, gap) by text; the neighbours come by text, highest cosine first."""
        near, toxic = cosines**2, labels == 1
        share = (np.bincount(text, near * toxic, texts) + 1e-3 * 0.5) / (np.bincount(text, near, texts) + 1e-3)
        best = np.zeros((2, texts))
        for i, group in enumerate((~toxic, toxic)):
            own, at = np.unique(text[group], return_index=True)
            best[i, own] = cosines[group][at]
        return np.column_stack([np.ones(texts), share - 0.5, best[1] - best[0]])

    def score(self, texts: int, text: np.ndarray, labels: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        z = self.features(texts, text, labels, cosines) @ np.array(self.curve)
        return np.where(np.bincount(text, minlength=texts) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.prior)


def counted(docs: DataFrame, terms: Terms, kept: list[str]) -> DataFrame:
    """The ``kept`` columns, and the terms of the whole text with their occurrences (arrays __t and __n): the one pass over the texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms.counts(x) for x in batch.column(len(kept)).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = [np.fromiter((x for c in found for x in part(c)), np.int32) for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)], names=[*kept, "__t", "__n"])

    source = docs.select(*[f"`{c}`" for c in kept], F.coalesce("text", F.lit("")).alias("__text"))
    return source.mapInArrow(run, ", ".join([*filter(None, [schema]), "__t array<int>", "__n array<int>"]))


def held_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, n): of one task's texts those that hold term t, from their distinct terms; t = -1 counts the texts."""
    df, texts = np.zeros(0, np.int64), 0
    for batch in batches:
        found = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        found[: len(df)] += df
        df, texts = found, texts + batch.num_rows
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(df[held], texts), pa.int64())], names=["t", "n"])


def choose_terms(texts: list[str], y: np.ndarray, min_examples: int, min_association: float) -> list[str]:
    """Terms of ``min_examples`` examples or more whose presence goes with the class (chi-squared of the two by two table). On texts in
    which nearly every word is one of a kind the cosine over all words finds few of the toxic texts, so it is taken over these."""
    # most terms occur in one text only: a table of counts by hash, never too low, keeps them out of the counters
    table = np.zeros(1 << 22, np.uint16)
    bag = lambda text: {t for w in set(words(text)) for t in terms_of(w)}
    for text in texts:
        np.add.at(table, np.fromiter((hash(t) & 0x3FFFFF for t in bag(text)), np.int64), 1)
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, y):
        (toxic if label else clean).update(t for t in bag(text) if table[hash(t) & 0x3FFFFF] >= min_examples)
    p, n = int((y == 1).sum()), int((y == 0).sum())
    found = []
    for t in toxic.keys() | clean.keys():
        a, b = toxic[t], clean[t]
        if a + b >= min_examples and a + b < p + n and p and n and (p + n) * (a * (n - b) - b * (p - a)) ** 2 / ((a + b) * (p + n - a - b) * p * n) >= min_association:
            found.append(t)
    return sorted(found)


def flat_counts(terms: Terms, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [terms.counts(x) for x in texts]
    each = lambda part: np.fromiter((x for c in found for x in part(c)), np.int64)
    return np.cumsum([0, *map(len, found)]), each(dict.keys), each(dict.values)


def build_index(sample: pd.DataFrame, terms: Terms, total: int, df: np.ndarray) -> Index:
    """Index of the sample; idf comes from ``total`` documents, df[t] of which hold term t. Examples are ordered by class and then by
    their heaviest terms, so that a block holds alike examples and its bounds are tight."""
    size = len(terms.number)
    none = np.empty(0, np.int64)
    index = Index(terms, np.log((1 + total) / (1 + df)) + 1, none, none, none, none, none, none)
    if size:
        index.idf[terms.number[OTHER]] = OTHER_WEIGHT
    starts, t, n = flat_counts(terms, list(sample.text))
    rows = np.repeat(np.arange(len(sample)), np.diff(starts))
    w = index.unit(rows, t, n)
    lead = [int(t[a + np.argmax(w[a:b])]) if b > a else -1 for a, b in zip(starts, starts[1:])]
    order = np.lexsort((sample.doc_id.to_numpy(), lead, sample.y.to_numpy()))
    index.ids, index.labels = sample.doc_id.to_numpy()[order], sample.y.to_numpy()[order]
    cols = np.argsort(order)[rows]
    by = np.lexsort((cols, t))
    t, index.cols, index.weights = t[by], cols[by], w[by]
    blocks = -(-len(order) // BLOCK)
    index.cut = np.searchsorted(t * (blocks + 1) + index.cols // BLOCK, np.arange(size * (blocks + 1))).reshape(size, blocks + 1)
    index.block_max = np.zeros((size, blocks))
    np.maximum.at(index.block_max, (t, index.cols // BLOCK), index.weights)
    return index


def calibrate(index: Index, sample: pd.DataFrame, counts: tuple[int, int], k: int) -> Votes:
    """Fits the curve on leave-one-out neighbours of the examples, weighed to the class counts of all training labels."""
    prior = (counts[1] + 1) / (sum(counts) + 2)
    if len(set(index.labels.tolist())) < 2:
        return Votes(prior, (float(np.log(prior / (1 - prior))), 0.0, 0.0))
    text = dict(zip(sample.doc_id, sample.text))
    found = []
    for at in range(0, len(index.ids), CHUNK):
        own = np.arange(at, min(at + CHUNK, len(index.ids)))
        near, ex, cosines = index.nearest(*flat_counts(index.terms, [text[d] for d in index.ids[own]]), k, own)
        found.append(Votes.features(len(own), near, index.labels[ex], cosines))
    x, y = np.concatenate(found), index.labels.astype(float)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    b = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.05])
        b = b - np.linalg.solve(h, x.T @ (weight * (p - y)) + np.array([0, 0.05, 0.05]) * b)
    return Votes(prior, tuple(map(float, b)))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = 1024, longest: int = 65_536, k: int = 15, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) plus held_out, score, predicted and evidence (array of the k nearest examples: id,
    label, cosine), one row per row of ``docs``.

    The index holds at most ``most`` labelled rows of each class outside the held-out fold, of at most ``longest`` bytes each: these
    bound what reaches the driver and what is broadcast. Term statistics cover all documents, and texts of any length are scored whole;
    they are read once, and their counts are stored beside the kept columns. A null or empty text scores the share of toxic rows among the
    training labels. All examples that tie with the k-th vote; the evidence lists k, lower example first. A null id is never held out.
    Repeated rows score alike. Columns of ``docs`` with the names of new ones are replaced; other columns of ``labels`` are ignored.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("held_out", "score", "predicted", "evidence")]
    sample = labelled_sample(docs, labels, "toxic", folds, held, most, longest).toPandas().sort_values("doc_id", ignore_index=True)
    terms = Terms(choose_terms(list(sample.text), sample.y.to_numpy(), 3, 10.0))
    rows = stored(counted(docs, terms, kept), "toxicity-terms")
    df = np.zeros(len(terms.number), np.int64)
    total = 0
    # each task adds up its own texts' terms, so that no row is made for a term of a text
    for r in rows.select("__t").mapInArrow(held_counts, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        if r.t < 0:
            total = r.n
        else:
            df[r.t] = r.n
    index = build_index(sample, terms, total, df)
    votes = calibrate(index, sample, class_counts(docs, labels, "toxic", folds, held), k)
    del sample
    terms.forget()
    shared = docs.sparkSession.sparkContext.broadcast((index, votes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, curve = shared.value
        evidence = pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())])
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                n = batch.num_rows
                starts = batch.column(len(kept)).offsets.to_numpy().astype(np.int64)
                t, many = (batch.column(len(kept) + i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                text, ex, cosines = found.nearest(starts - starts[0], t, many, k)
                scores = curve.score(n, text, found.labels[ex], cosines)
                begins = np.searchsorted(text, np.arange(n))
                shown = np.arange(len(text)) - begins[text] < k
                ends = np.cumsum(np.concatenate(([0], np.bincount(text[shown], minlength=n))))
                why = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((found.ids[ex[shown]], found.labels[ex[shown]], cosines[shown]), evidence)], fields=list(evidence))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.round(scores, 6)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), why)], names=[*kept, "score", "evidence"])

    if "text" not in kept:  # the counts alone are so small that files of them hold far more texts than a task should search
        rows = rows.repartition(max(1, -(-total // TASK_TEXTS)))
    scored = rows.select(*[f"`{c}`" for c in kept], "__t", "__n").mapInArrow(run, f"{schema}, score double, evidence array<struct<id:bigint,label:int,cosine:double>>")
    return scored.select(
        *[f"`{c}`" for c in kept], F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
