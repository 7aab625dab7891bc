"""Exact substring dedup with fixed-block anchors.

Non-overlapping reference blocks of every text are indexed and probed with every rolling window of the same length; a block is
short enough that any repeat of ``width`` words holds a whole one. Hits are then extended: every window of ``width`` words through
a hit is compared, and runs of repeated windows are the maximal exact repeats.

Hashes travel packed: a task hashes a batch of texts with numpy and sends one binary row to each bucket of the hash space, and
Spark shuffles the buckets. Only counts per hash matter, never pairs, so a group of copies costs as much as its texts. A hash
that a batch holds several times is sent once, so that a passage found everywhere sends one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import row_key

#: Bytes hashed at once, words of one batch, and text bytes that one bucket of the hash space stands for.
PIECE, BATCH_WORDS, BUCKET_BYTES = 1 << 20, 1_000_000, 8_000_000
#: Text bytes of one task.
TASK_BYTES = 32_000_000
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Values and factors of a second, independent hash: what is counted as a repeat agrees in it and in the first one's bucket.
OTHER_VALUES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
OTHER_BASE, OTHER_STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PACKED = "bucket int, batch long, kind int, a binary, b binary, c binary"
PROBES, HEADER, FOUND = 0, 1, 2


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, b in (("up", self.base), ("down", self.inverse)):
                fill = np.full(2 * n, b, np.uint64)
                fill[0] = 1
                setattr(self, name, np.multiply.accumulate(fill))
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from one running sum."""
    up, down = powers.get(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(texts: list[bytes], powers: Powers, byte_values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text."""
    joined = b"\n".join(texts) + b"\n"
    found, at = [], 0
    starts_all = []
    while at < len(joined):
        end = min(at + PIECE, len(joined))
        while end < len(joined) and not SPACE[joined[end]]:
            end += 1
        raw = np.frombuffer(joined, np.uint8, end - at, at)
        gap = np.concatenate(([True], SPACE[raw], [True])).view(np.int8)
        edge = np.diff(gap)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append(span_hashes(byte_values[raw], starts, ends, powers))
        starts_all.append(starts + at)
        at = end
    starts = np.concatenate(starts_all) if starts_all else np.empty(0, np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(starts, begins)
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.diff(cuts)


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    return span_hashes(words, at, at + width, powers) if len(at) else np.empty(0, np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Byte planes of increasing positions' differences; the zero planes vanish when the shuffle compresses."""
    d = np.diff(x, prepend=0).astype(np.uint32)
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(d, dtype=np.int64)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list]]:
    """(keys, texts, hits where there are any) in runs of about BATCH_WORDS words."""
    keys, texts, rest, size = [], [], [], 0
    for batch in batches:
        third = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * batch.num_rows
        for k, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), third):
            keys.append(k)
            texts.append(t or b"")
            rest.append(x)
            size += len(texts[-1])
            if size >= 6 * BATCH_WORDS:
                yield np.array(keys, np.int64), texts, rest
                keys, texts, rest, size = [], [], [], 0
    if keys:
        yield np.array(keys, np.int64), texts, rest


def pack(keys: np.ndarray, sizes: np.ndarray, at: np.ndarray, hashes: np.ndarray, aligned: np.ndarray, buckets: int, other: np.ndarray | None) -> pa.RecordBatch:
    """Rows of one batch: its header, the positions it found repeated itself, and the probes for each bucket. What is compared in a bucket is ``other``, a hash of
    its own keys, or without it the lower half of ``hashes``."""
    batch = np.int64(np.uint64(xxhash.xxh64_intdigest(keys.tobytes())).view(np.int64))
    order = np.argsort(hashes, kind="stable")
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1])) if len(order) else np.empty(0, bool)
    if other is not None and len(order):
        same[1:] &= other[order][1:] == other[order][:-1]
    many = np.zeros(len(hashes), bool)
    many[order[same]] = True
    many[order[np.flatnonzero(same) - 1]] = True
    later = np.zeros(len(hashes), bool)
    later[order[same]] = True
    # an alignment counts for the one occurrence that is sent
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    any_aligned = aligned.copy()
    np.logical_or.at(any_aligned, order[lead], aligned[order])
    rows: list[tuple] = [
        (int(np.uint64(batch.view(np.uint64)) % np.uint64(buckets)), int(batch), HEADER, keys.tobytes(), sizes.astype(np.uint32).tobytes(), b""),
        (int(np.uint64(batch.view(np.uint64)) % np.uint64(buckets)), int(batch), FOUND, planes(at[many]), b"", b""),
    ]
    sent = np.flatnonzero(~later)
    bucket = ((hashes[sent] >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
    by = np.argsort(bucket, kind="stable")
    # occupied buckets only, so that steps and rows stay below the number of words, however many buckets there are
    met, firsts = np.unique(bucket[by], return_index=True)
    for b, i, j in zip(met.tolist(), firsts, [*firsts[1:], len(by)]):
        own = sent[by[i:j]]
        value = hashes[own].astype(np.uint32) if other is None else other[own]
        flags = np.packbits(np.concatenate((any_aligned[own], many[own])))
        rows.append((b, int(batch), PROBES, value.tobytes(), planes(at[own]), flags.tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "batch", "kind", "a", "b", "c"])


def probe_map(block: int, buckets: int) -> Callable:
    """Every rolling window of ``block`` words of every text; those at multiples of ``block`` are the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_powers, word_powers = Powers(BASE), Powers(STEP)
        for keys, texts, _ in batches_of(batches):
            words, sizes = hash_words(texts, byte_powers)
            ends = np.repeat(np.cumsum(sizes), sizes)
            begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(np.arange(len(words)) + block <= ends)
            yield pack(keys, sizes, at, window_hashes(words, at, block, word_powers), (at - begins[at]) % block == 0, buckets, None)

    return run


def extend_map(block: int, width: int, buckets: int) -> Callable:
    """Every window of ``width`` words that holds a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_powers, word_powers = Powers(BASE), Powers(STEP)
        other_bytes, other_words = Powers(OTHER_BASE), Powers(OTHER_STEP)
        for keys, texts, hits in batches_of(batches):
            words, sizes = hash_words(texts, byte_powers)
            others, _ = hash_words(texts, other_bytes, OTHER_VALUES)
            begins = np.cumsum(sizes) - sizes
            edge = np.zeros(len(words) + 1, np.int32)
            for begin, size, blob in zip(begins, sizes, hits):
                p = np.frombuffer(blob, np.uint32).astype(np.int64)
                np.add.at(edge, begin + np.maximum(p - (width - block), 0), 1)
                np.add.at(edge, begin + np.maximum(np.minimum(p, size - width) + 1, 0), -1)
            ends = np.repeat(begins + sizes, sizes)
            at = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (np.arange(len(words)) + width <= ends))
            yield pack(keys, sizes, at, window_hashes(words, at, width, word_powers), np.ones(len(at), bool), buckets, window_hashes(others, at, width, other_words))

    return run


def count_bucket(short: bool) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: the positions of probes whose hash is indexed and was seen twice or more; headers pass through."""

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        values, wheres, owners, aligned, many = [], [], [], [], []
        batches: list[int] = []
        for batch, kind, a, b, c in zip(*(rows.column(x).to_pylist() for x in ("batch", "kind", "a", "b", "c"))):
            if kind != PROBES:
                out.append((batch, kind, a, b))
                continue
            v = np.frombuffer(a, np.uint32 if short else np.uint64)
            flags = np.unpackbits(np.frombuffer(c, np.uint8), count=2 * len(v)).astype(bool)
            values.append(v)
            wheres.append(unplanes(b).astype(np.uint32))
            owners.append(np.full(len(v), len(batches), np.int32))
            aligned.append(flags[: len(v)])
            many.append(flags[len(v) :])
            batches.append(batch)
        if values:
            v, own, index = np.concatenate(values), np.concatenate(owners), np.concatenate(aligned)
            known = np.unique(v[index])
            spot = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
            hit = known[spot] == v if len(known) else np.zeros(len(v), bool)
            seen = np.bincount(spot[hit], minlength=len(known)) + np.bincount(spot[hit], np.concatenate(many)[hit], len(known))
            hit &= seen[spot] >= 2 if len(known) else False
            where, own = np.concatenate(wheres)[hit], own[hit]
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(batches) + 1))
            out += [(x, FOUND, planes(where[order[i:j]].astype(np.int64)), b"") for x, i, j in zip(batches, cuts, cuts[1:]) if j > i]
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "kind", "a", "b"])

    return run


def unpack_batch(width: int | None) -> Callable[[pa.Table], pa.Table]:
    """Of one batch: the positions found, by text. With ``width``, runs of windows as (start, end) word spans, else plain positions."""

    def run(rows: pa.Table) -> pa.Table:
        header, found = None, []
        for kind, a, b in zip(*(rows.column(x).to_pylist() for x in ("kind", "a", "b"))):
            if kind == HEADER:
                header = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32).astype(np.int64)
            elif a:
                found.append(unplanes(a))
        keys, blobs = [], []
        if header is not None and found:
            at = np.unique(np.concatenate(found))
            ends = np.cumsum(header[1])
            cuts = np.searchsorted(at, np.concatenate(([0], ends)))
            for key, begin, i, j in zip(header[0].tolist(), ends - header[1], cuts, cuts[1:]):
                if j > i:
                    p = at[i:j] - begin
                    if width:
                        first = np.concatenate(([True], np.diff(p) > 1))
                        last = np.concatenate((np.diff(p) > 1, [True]))
                        p = np.stack([p[first], p[last] + width], axis=1).ravel()
                    keys.append(key)
                    blobs.append(p.astype(np.uint32).tobytes())
        return pa.table([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "spans"])

    return run


def _round(packed: DataFrame, short: bool, width: int | None, parts: int) -> DataFrame:
    counted = packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count_bucket(short), "batch long, kind int, a binary, b binary")
    spans = counted.repartition(parts, "batch").groupBy("batch").applyInArrow(unpack_batch(width), "key long, spans binary")
    return spans.groupBy("key").agg(F.first("spans").alias("spans"))


def repeated_spans(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: key, id, text as bytes. spans: key and packed (start, end) word positions of maximal repeats, for texts
    that have any; the key stands for (id, text), so rows alike share it. Each maximal repeat is made of windows of ``width``
    words whose words also start elsewhere, in the same text or another."""
    block = (width + 1) // 2
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(12, -(-size // BUCKET_BYTES))
    # tasks follow the bytes, so that the largest one stays the same at every size
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    texts = source.repartition(parts, "key")
    # every reader of ``texts`` takes all its columns, so that one exchange serves them all
    probed = texts.sortWithinPartitions("key").mapInArrow(probe_map(block, buckets), PACKED)
    hits = _round(probed, True, None, parts)
    joined = texts.join(hits, "key").select("key", "text", "id", F.col("spans").alias("hits"))
    extended = joined.sortWithinPartitions("key").mapInArrow(extend_map(block, width, buckets), PACKED)
    return texts, _round(extended, False, width, parts)


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words joined by one space) and spans (array of [start, end) word positions), one row per row.

    Removes each word that lies in a window of ``width`` words which also starts anywhere else; windows are judged on the input.
    Null, empty and shorter texts lose nothing; texts of any length are treated whole. Repeated rows count as two texts, so from ``width``
    words on both lose all. Other columns are ignored, whatever their names.
    """
    texts, spans = repeated_spans(docs, width, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept, cuts = [], [], [], []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                pairs = np.frombuffer(blob or b"", np.uint32).reshape(-1, 2).tolist()
                rest, at, gone = [], 0, 0
                for start, end in pairs:
                    start = max(start, at)
                    rest += words[at:start]
                    gone += max(0, end - start)
                    at = max(at, end)
                rest += words[at:]
                sizes.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(rest).decode("utf-8"))
                cuts.append(pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(cuts, pa.list_(pa.list_(pa.int64())))],
                names=[id_col, "n_words", "n_removed", "kept_text", "spans"],
            )

    joined = texts.join(spans, "key", "left").select("id", "text", "spans", "key")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string, spans array<array<bigint>>")
