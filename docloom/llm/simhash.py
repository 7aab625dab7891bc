"""SimHash near-duplicates: pigeonhole blocks, block joins, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, cut, meet, stored

#: Members of a block bucket that one numpy step compares at once.
TILE = 512


def simhash64(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text: majority bit over the XXH64 of its word shingles, ASCII lower-cased; no words: 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    ends = (starts + sizes)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long): map-only. A null text counts as one without words: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash64(x, width, seed) if x else 0 for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def block_masks(distance: int, spare: int) -> list[int]:
    """Masks of all choices of ``spare`` out of ``distance + spare`` blocks: fingerprints within the distance agree on one of them."""
    n = distance + spare
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, spare)]


def _run_links(fps: np.ndarray, reps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one bucket: each member goes to the lowest label it meets, tile by tile."""
    n = len(fps)
    label = np.arange(n)
    changed = True
    while changed:
        before = label.copy()
        for at in range(0, n, TILE):
            near = np.bitwise_count(fps[at : at + TILE, None] ^ fps[None, :]) <= distance
            label[at : at + TILE] = np.where(near, label[None, :], n).min(axis=1)
        label = label[label]
        changed = not np.array_equal(before, label)
    rest = np.flatnonzero(label != np.arange(n))
    return [(reps[rest], reps[label[rest]])] if len(rest) else []


def _bucket_links(distance: int, small: int = 32):
    """mapInArrow over rows sorted by bucket: (a, b) links; small buckets of a batch are compared together, lag by lag."""

    def links(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(edges)
        few = np.repeat(sizes <= small, sizes)
        for lag in range(1, min(small, int(sizes.max()))):
            same = (keys[lag:] == keys[:-lag]) & few[lag:]
            i = np.flatnonzero(same & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= distance))
            if len(i):
                found.append((reps[i + lag], reps[i]))
        for k in np.flatnonzero(sizes > small):
            s = slice(edges[k], edges[k + 1])
            found += _run_links(fps[s], reps[s], distance)
        a, b = (np.concatenate([x[j] for x in found]) if found else np.empty(0, np.int64) for j in (0, 1))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
            last = np.flatnonzero(cols[0] != cols[0][-1])
            at = int(last[-1]) + 1 if len(last) else 0
            rest = [x[at:] for x in cols]
            if at:
                yield links(cols[0][:at], cols[1][:at].view(np.uint64), cols[2][:at])
        if rest is not None and len(rest[0]):
            yield links(rest[0], rest[1].view(np.uint64), rest[2])

    return run


def near_links(nodes: DataFrame, distance: int = 4, spare: int = 3, chunk: int = 8192) -> DataFrame:
    """Links (a, b) that connect all nodes (rep long, fp long, distinct fp) within ``distance`` bits.

    Pigeonhole: of ``distance + spare`` blocks of the fingerprint, close pairs agree on at least ``spare``; every choice of
    blocks is a bucket key, and only members of one bucket are compared. Buckets come out as a spanning forest, never as all
    pairs. A bucket of over ``chunk`` members is dealt out as pairs of chunks, so that no task holds more than two chunks of it.
    """
    masks = block_masks(distance, spare)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for i, m in enumerate(masks)])
    members = nodes.select("rep", "fp", F.explode(keys).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(shared.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")), "shared")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = meet(members, shared, "bucket", F.xxhash64("rep")).withColumn("own", own)
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    dealt = dealt.withColumn("other", other)
    tile = F.when(F.col("parts") > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket"))
    rows = dealt.select(tile.alias("tile"), "fp", "rep")
    rows = rows.repartition("tile").sortWithinPartitions("tile", "rep")
    return rows.mapInArrow(_bucket_links(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row per document: (id, fingerprint string, component_id = smallest id reachable over links of at most ``distance`` bits).

    Equal fingerprints collapse to one node before any comparison, so that groups of exact copies cost nothing.
    Null, empty and wordless texts all have fingerprint 0 and link like any other. Rows with a null id are their own
    component with component_id null unless they share a fingerprint with rows that have an id. Repeated rows stay. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Fingerprints and buckets that hold a large share of all rows are dealt over tasks.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "nodes")
    linked = near_links(nodes.where("rep is not null"), distance)
    parts = components(linked)
    named = stored(nodes.join(parts, nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"), "named")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # one fingerprint may be that of most documents, some without an id: its rows are dealt by their place, which is fixed since they are cut
    return meet(fps, named, "fp", F.xxhash64("id", F.monotonically_increasing_id())).select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id; all columns of ``docs``.

    A row without an id takes part under a hash of its text. Rows that repeat an id count as one document, of which the row with the smallest text stays, and
    among equal texts the one whose other columns hash lowest. Null and empty texts are near-duplicates of each other; an empty table stays empty.
    """
    named = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    first = near_duplicates(named.select("__id", "text"), id_col="__id", **options).where("__id = component_id").select("__id").distinct()
    rest = [c for c in docs.columns if c != "text"]
    lowest = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in rest])))
    return named.join(first, "__id", "left_semi").groupBy("__id").agg(lowest.alias("s")).select("s.*")
