"""Sets over few tokens, each token in many sets: rows of a matrix of zeros and ones that are multiplied tile by tile, so that no pair is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.shared import stored

#: Tokens of a matrix at most; they are broadcast. Sets over more of them are joined by tokens.
WIDE = 8192
#: Pairs of rows with a common token that a join may put out; up to here a join is taken.
FEW = 1 << 22
#: A pair of a join costs as much as so many products of a matrix.
PRODUCTS = 1000
#: Sets of one tile, tiles of one part of a row of tiles, and sets that are multiplied with a tile at once.
TILE, PART, SLICE = 4096, 64, 256
#: Types of tokens that are written out.
TYPES = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}


@dataclass(frozen=True)
class Tokens:
    """The tokens in order; (token, no) as a table."""

    values: list
    table: DataFrame


def dense(each: DataFrame, other: DataFrame | None = None) -> Tokens | None:
    """The tokens of rows (id, token), or None if a join of the two by tokens puts out few pairs, or fewer than a matrix has to multiply for."""
    kind = each.schema["token"].dataType
    if kind not in TYPES:
        return None
    sides = [each] if other is None else [each, other]
    counted = None
    for i, side in enumerate(sides):
        n = side.groupBy("token").agg(F.count("*").alias(f"n{i}"))
        counted = n if counted is None else counted.join(n, "token", "full")
    counted = stored(counted.fillna(0), "tokens")
    last = len(sides) - 1
    found = counted.agg(F.count("*").alias("n"), F.count_if(F.col("token").isNull()).alias("none"), F.sum(F.col("n0").cast("double") * F.col(f"n{last}")).alias("pairs")).first()
    if not found.n or found.none or found.n > WIDE or found.pairs <= FEW:
        return None
    sets = [s.select("id").distinct().count() for s in sides]
    if sets[0] * sets[last] * found.n > PRODUCTS * found.pairs:
        return None
    values = [r.token for r in counted.select("token").orderBy("token").collect()]
    return Tokens(values, each.sparkSession.createDataFrame(list(zip(values, range(len(values)))), T.StructType([T.StructField("token", kind), T.StructField("no", T.IntegerType())])))


def tiled(each: DataFrame, tokens: Tokens, name: str) -> tuple[DataFrame, int]:
    """((``name``, ids, values, bits), number of tiles) of distinct rows (id, token) or (id, value, token): the sets of a tile, one bit a token. Stored."""
    keys = [c for c in each.columns if c != "token"]
    sets = stored(each.join(F.broadcast(tokens.table), "token").groupBy(*keys).agg(F.collect_list("no").alias("set")), "numbered")
    n, width = max(1, -(-sets.count() // TILE)), len(tokens.values)
    value = F.col("value").cast("long") if "value" in keys else F.lit(0).cast("long")
    packed = sets.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("tile"), F.struct("id", value.alias("value"), "set").alias("s")).groupBy("tile").agg(F.collect_list("s").alias("s"))
    rows = packed.select("tile", F.col("s.id").alias("ids"), F.col("s.value").alias("values"), F.col("s.set").alias("sets"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for sets in batch.column(3):
                sets = sets.values
                ones = np.zeros((len(sets), width), bool)
                sizes = np.diff(sets.offsets.to_numpy())
                ones[np.repeat(np.arange(len(sets)), sizes), sets.flatten().to_numpy()] = True
                bits.append(np.packbits(ones, axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits, pa.binary())], names=["tile", "ids", "values", "bits"])

    kind = rows.schema["ids"].dataType.simpleString()
    return stored(rows.mapInArrow(pack, f"tile int, ids {kind}, values array<long>, bits binary").withColumnRenamed("tile", name), "incidence"), n


def met(left: DataFrame, right: DataFrame, n_right: int, same: bool) -> DataFrame:
    """Each tile a beside each tile b, or beside those from a on."""
    side = lambda tiles, s: tiles.select(s, *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "values", "bits")])
    asked = left.select("a", F.explode(F.sequence(F.col("a") if same else F.lit(0), F.lit(n_right - 1))).alias("b"))
    return asked.join(side(left, "a"), "a").join(side(right, "b"), "b")


def matrix(bits: bytes, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, -(-width // 8)), axis=1, count=width).view(bool)


def similar(left: DataFrame, right: DataFrame | None, tokens: Tokens, threshold: float, most: int) -> DataFrame:
    """(l, r, score, overlap): pairs of the sets of distinct rows (id, token) with a Jaccard index of ``threshold`` or more, with up to ``most`` common tokens.
    Without ``right`` the pairs of two sets of ``left``, once each, l < r. Pairs come out of the multiplication as they are written."""
    a, n_a = tiled(left, tokens, "a")
    b, n_b = (a.withColumnRenamed("a", "b"), n_a) if right is None else tiled(right, tokens, "b")
    width, values, once = len(tokens.values), tokens.values, right is None
    token, kind = left.schema["token"].dataType, left.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array(values, TYPES[token])
        for batch in batches:
            for row in range(batch.num_rows):
                ids, others = (batch.column(c)[row].values for c in ("ids_a", "ids_b"))
                ones, many = (matrix(batch.column(c)[row].as_py(), width) for c in ("bits_a", "bits_b"))
                sizes, turned = many.sum(axis=1), many.T.astype(np.float32)
                twins = once and batch.column("a")[row].as_py() == batch.column("b")[row].as_py()
                for at in range(0, len(ones), SLICE):
                    part = ones[at : at + SLICE]
                    common = part.astype(np.float32) @ turned
                    score = common.astype(np.float64) / (part.sum(axis=1)[:, None] + sizes - common)
                    near = score >= threshold - 1e-12
                    if twins:
                        near &= np.arange(len(many)) > np.arange(at, at + len(part))[:, None]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    both = part[i] & many[j]
                    first, every = np.full((len(i), most), -1), np.arange(len(i))
                    for k in range(most):
                        col = both.argmax(axis=1)
                        first[:, k] = np.where(both[every, col], col, -1)
                        both[every, col] = False
                    ends = np.cumsum(np.concatenate(([0], (first >= 0).sum(axis=1))))
                    overlap = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named.take(pa.array(first[first >= 0])))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), others.take(pa.array(j)), pa.array(score[i, j]), overlap], names=["l", "r", "score", "overlap"])

    pairs = n_a * (n_a + 1) // 2 if once else n_a * n_b
    rows = met(a, b, n_b, once).repartition(pairs, "a", "b").mapInArrow(run, f"l {kind}, r {kind}, score double, overlap array<{token.simpleString()}>")
    if once:
        rows = rows.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "score", "overlap")
    return rows.withColumn("score", F.round("score", 6))


def expansions(each: DataFrame, tokens: Tokens) -> DataFrame:
    """(k, token, weight): for each set of distinct rows (id, value, token) the tokens that it lacks, with the sum of the values of the sets that share a token with
    it and hold that one. A tile's sums are made from all tokens of a tile beside it, less those of sets without a common token, or from those with one,
    whichever are fewer."""
    a, n = tiled(each, tokens, "a")
    width, kind = len(tokens.values), each.schema["id"].dataType.simpleString()

    def out(ids: pa.Array, ones: np.ndarray, total: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ones), SLICE):
            i, t = np.nonzero((count[at : at + SLICE] > 0) & ~ones[at : at + SLICE])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + i)), pa.array(t, pa.int32()), pa.array(total[at + i, t])], names=["k", "no", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in range(batch.num_rows):
                key = (batch.column("a")[row].as_py(), batch.column("part")[row].as_py())
                if now is None or now[0] != key:
                    if now is not None:
                        yield from out(*now[1:])
                    ones = matrix(batch.column("bits_a")[row].as_py(), width)
                    now = (key, batch.column("ids_a")[row].values, ones, np.zeros(ones.shape, np.int64), np.zeros(ones.shape, np.int64))
                _, _, ones, total, count = now
                many = matrix(batch.column("bits_b")[row].as_py(), width)
                turned, value = many.T.astype(np.float32), np.asarray(batch.column("values_b")[row].values)
                held = np.concatenate([many * value[:, None], many], axis=1).astype(np.float64)
                whole = held.sum(axis=0)
                for at in range(0, len(ones), SLICE):
                    linked = ones[at : at + SLICE].astype(np.float32) @ turned > 0
                    fewer = ~linked if 2 * np.count_nonzero(linked) > linked.size else linked
                    found = fewer.astype(np.float64) @ held if fewer.any() else np.zeros((len(linked), 2 * width))
                    found = found if fewer is linked else whole - found
                    total[at : at + SLICE] += found[:, :width].astype(np.int64)
                    count[at : at + SLICE] += found[:, width:].astype(np.int64)
        if now is not None:
            yield from out(*now[1:])

    rows = met(a, a.withColumnRenamed("a", "b"), n, False).withColumn("part", F.floor(F.col("b") / PART).cast("int"))
    parts = n * -(-n // PART)
    found = rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, f"k {kind}, no int, weight long")
    if n > PART:
        found = found.groupBy("k", "no").agg(F.sum("weight").alias("weight"))
    return found.join(F.broadcast(tokens.table), "no").select("k", "token", "weight")
