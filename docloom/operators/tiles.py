"""Vectors packed into tiles, and which pairs of tiles can hold near vectors: chosen from the tiles' metadata, so that values move for those pairs alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.shared import stored

#: Vectors of one tile, at about.
TILE = 1024
#: Cells of the space: one for so many tiles, within these bounds; their centres are what is broadcast.
TILES_A_CELL, CELLS = 4, (1, 1024)
#: Tiles meet by groups. A group has at most so many tiles and bytes of vectors, and there are so many groups at least, for tasks to share.
GROUP_TILES, GROUP_BYTES, GROUPS = 64, 1 << 25, 12


def centres_of(vectors: DataFrame, n_vectors: int, n: int | None = None) -> np.ndarray:
    """Cell centres: vectors chosen by hash, a bounded sample for partitioning the space, not for results."""
    n = n or min(max(n_vectors // (TILE * TILES_A_CELL), CELLS[0]), CELLS[1])
    rows = vectors.orderBy(F.xxhash64("item_id", "v"), "item_id").select("v").limit(n).collect()
    return np.array([r.v for r in rows])


def tiled(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(tile, cell, reach, ids, v): tiles of vectors that are nearest to the same centre, none farther from it than ``reach``. vectors: item_id long, v array<double> of
    one size. Stored; a cell of any size is dealt over as many tiles as it needs."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, centres.shape[1])
            far = np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1), 0))
            cell = far.argmin(axis=1) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(v)), cell])], names=["item_id", "v", "cell", "far"])

    placed = stored(vectors.select("item_id", "v").mapInArrow(place, "item_id long, v array<double>, cell int, far double"), "placed")
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))  # one row a cell
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    rows = dealt.groupBy("cell", "part").agg(F.max("far").alias("reach"), F.collect_list(F.struct("item_id", "v")).alias("s"))
    rows = rows.select(
        (F.col("cell").cast("long") * (1 << 40) + F.col("part")).alias("tile"), "cell", (F.col("reach") * (1 + 1e-9) + 1e-7).alias("reach"),
        F.transform("s", lambda s: s["item_id"]).alias("ids"), F.flatten(F.transform("s", lambda s: s["v"])).alias("v"),
    )
    return stored(rows, "tiles")


def near_pairs(first: DataFrame, second: DataFrame, centres: np.ndarray, near: Callable[[Column], Column]) -> DataFrame:
    """(a, b): pairs of tile numbers that ``near`` keeps. The frames hold metadata only: tile, cell, reach and what ``near`` reads, whose columns get the endings _a
    and _b; it is given the least distance that two vectors of the tiles can have, by the triangle inequality over their centres."""
    spark = first.sparkSession
    apart = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0)) if len(centres) <= 256 else np.stack([np.sqrt(((centres - c) ** 2).sum(axis=1)) for c in centres])
    i, j = np.divmod(np.arange(apart.size), len(centres))
    table = spark.createDataFrame(pa.table({"cell_a": pa.array(i, pa.int32()), "cell_b": pa.array(j, pa.int32()), "apart": pa.array(apart.ravel())}))
    a = first.select(*[F.col(c).alias(f"{c}_a") for c in first.columns])
    b = second.select(*[F.col(c).alias(f"{c}_b") for c in second.columns])
    cells = table.join(F.broadcast(a.groupBy("cell_a").agg(F.max("reach_a").alias("far_a"))), "cell_a").join(F.broadcast(b.groupBy("cell_b").agg(F.max("reach_b").alias("far_b"))), "cell_b")
    least = F.greatest(F.lit(0.0), F.col("apart") - F.col("reach_a") - F.col("reach_b"))
    return a.join(F.broadcast(cells.select("cell_a", "cell_b", "apart")), "cell_a").join(b, "cell_b").where(near(least)).select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))


def groups_of(tiles: DataFrame, size: int) -> DataFrame:
    """(tile, g): group numbers of tiles (tile, cell) of vectors with ``size`` values; the tiles of a cell are neighbours. Only the tiles' numbers are looked at."""
    n = tiles.count()
    most = max(min(GROUP_TILES, GROUP_BYTES // (TILE * size * 8)), 1)
    groups = max(min(n, max(GROUPS, -(-n // most))), 1)
    return stored(tiles.select("tile", F.ntile(groups).over(Window.orderBy("cell", "tile")).alias("g")), "groups")


def met_in_groups(pairs: DataFrame, first: DataFrame, second: DataFrame | None, groups: tuple[DataFrame, DataFrame], run: Callable, shape: str) -> DataFrame:
    """What ``run`` makes of the pairs (a, b) of tiles. It is called for two groups of tiles at a time, so that values move once a pair of groups and not once a pair of
    tiles, with a table of tiles, columns as in ``first`` and ``second``, and a list of pairs of its rows. Without ``second`` both tiles of a pair are of ``first``, and a
    call has all pairs of its two groups, either way round."""
    one = second is None
    g = [x.select(F.col("tile").alias(s), F.col("g").alias(f"g_{s}")) for x, s in zip(groups, "ab")]
    both = pairs.join(F.broadcast(g[0]), "a").join(F.broadcast(g[1]), "b")
    p, q = (F.least("g_a", "g_b"), F.greatest("g_a", "g_b")) if one else (F.col("g_a"), F.col("g_b"))
    lists = stored(both.groupBy(p.alias("p"), q.alias("q")).agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "meetings")
    ends = F.explode(F.array_distinct(F.array("p", "q"))) if one else F.col("p")
    side = lambda n, frame, end: frame.join(F.broadcast(groups[n]), "tile").join(F.broadcast(lists.select("p", "q", end.alias("g"))), "g").select("p", "q", F.lit(n).alias("side"), *frame.columns)
    rows = side(0, first, ends).unionByName(lists.withColumn("side", F.lit(2)), allowMissingColumns=True)
    rows = rows if one else rows.unionByName(side(1, second, F.col("q")), allowMissingColumns=True)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        at = {k: i for i, k in enumerate(zip(table.column("side").to_pylist(), table.column("tile").to_pylist()))}
        wanted = table.column("pairs")[at[2, None]].as_py()
        yield from run(table.to_batches()[0], sorted((at[0, z["a"]], at[0 if one else 1, z["b"]]) for z in wanted))

    return rows.groupBy("p", "q").applyInArrow(call, shape)


def values(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one side of a meeting."""
    ids, v = (np.asarray(batch.column(f"{c}{side}")[row].values) for c in ("ids", "v"))
    return ids, v.reshape(len(ids), -1)
