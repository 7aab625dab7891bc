"""Graphs as edge tables: connected components, and density clusters of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.vector import norm
from docloom.operators import tiles
from docloom.operators.skew import meet
from docloom.sources.shared import cut, stored

#: Vectors of one tile.
TILE = 1024


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as (a long, b long): rows (node, component), component = smallest node.

    Alternates large-star and small-star steps, each an aggregate and an equi-join, until nothing changes (a logarithmic
    number of rounds). Every round is cut into the shared checkpoint folder. Nodes without an edge to another node don't
    come out. Hub nodes: the side that repeats in a join is the edge list, which adaptive execution can split.
    """
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut(edges.where("a != b").select(big, small).distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = meet(both.where("v > u"), low, "u", F.xxhash64("v"), total=2 * state[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(root, "a")
        step = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b")))
        now = cut(step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.groupBy("a").agg(F.min("b").alias("b"))
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        ends.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def pivots(vectors: DataFrame, n: int, vector: str = "embedding") -> list[list[float]]:
    """``n`` unit vectors chosen by hash: a bounded sample for partitioning the space, not for results."""
    rows = vectors.where(norm(F.col(vector)) > 1e-8).orderBy(F.xxhash64("item_id"), "item_id").select(F.col(vector).cast("array<double>").alias("v")).limit(n).collect()
    return [[x / sum(y * y for y in r.v) ** 0.5 for x in r.v] for r in rows]


def _tiles(placed: DataFrame) -> DataFrame:
    """Vectors packed into tiles of up to about TILE, all of one cell: tile number, cell, the farthest distance from its pivot, ids, values."""
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts")))
    dealt = placed.join(parts, "cell").withColumn("tile", F.xxhash64("cell", F.pmod(F.xxhash64("item_id"), F.col("parts"))))
    packed = dealt.groupBy("tile", "cell").agg(F.max("far").alias("reach"), F.collect_list(F.struct("item_id", "u")).alias("v"))
    return stored(packed.select("tile", "cell", "reach", F.transform("v", lambda s: s["item_id"]).alias("ids"), F.flatten(F.transform("v", lambda s: s["u"])).alias("v")), "tiles")


class Meetings:
    """Unit vectors of items in tiles, and which tiles can hold vectors within ``min_cosine`` of each other: their pivots are no farther apart than their reaches and the
    threshold's distance together (triangle inequality on the chord distance). Without ``queries`` a pair of tiles comes once."""

    def __init__(self, vectors: DataFrame, min_cosine: float, centers: list[list[float]], queries: Column | None = None) -> None:
        radius = (2 - 2 * min_cosine) ** 0.5
        fixed = np.array(centers)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, fixed.shape[1])
                u = v / np.linalg.norm(v, axis=1, keepdims=True)
                far = np.sqrt(np.maximum(2 - 2 * u @ fixed.T, 0))
                cell = far.argmin(axis=1)
                ends = pa.array(np.arange(batch.num_rows + 1) * u.shape[1], pa.int32())
                own = [pa.ListArray.from_arrays(ends, pa.array(u.ravel())), pa.array(far[np.arange(len(u)), cell]), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *own, batch.column(2)], names=["item_id", "u", "far", "cell", "asked"])

        vector = F.col("embedding").cast("array<double>")
        usable = vectors.where((F.size(vector) == fixed.shape[1]) & (norm(vector) > 1e-8) & ~F.exists(vector, lambda x: x.isNull()))
        asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
        rows = usable.select(F.col("item_id").cast("long").alias("item_id"), vector.alias("v"), asked.alias("asked"))
        placed = stored(rows.mapInArrow(place, "item_id long, u array<double>, far double, cell int, asked boolean"), "placed")
        self.first = _tiles(placed if queries is None else placed.where("asked"))
        self.second = None if queries is None else _tiles(placed)
        self.groups = tuple(tiles.groups_of(t, fixed.shape[1]) for t in (self.first, self.second) if t is not None)
        apart = [(i, j, sum((x - y) ** 2 for x, y in zip(p, q)) ** 0.5) for i, p in enumerate(centers) for j, q in enumerate(centers)]
        near = vectors.sparkSession.createDataFrame(apart, "cell_a int, cell_b int, apart double")
        side = lambda t, s: t.select(F.col("tile").alias(s), F.col("cell").alias(f"cell_{s}"), F.col("reach").alias(f"reach_{s}"))
        pairs = side(self.first, "a").join(F.broadcast(near), "cell_a").join(side(self.first if queries is None else self.second, "b"), "cell_b")
        pairs = pairs.where(F.col("apart") <= F.col("reach_a") + F.col("reach_b") + radius + 1e-9)
        self.pairs = pairs.where("a <= b" if queries is None else "true").select("a", "b")

    def met(self, run: Callable, shape: str, first: DataFrame | None = None) -> DataFrame:
        """What ``run`` makes of the pairs of tiles (see ``tiles.met_in_groups``); ``first`` may be the tiles with more columns."""
        second = None if self.second is None else self.second.drop("cell", "reach")
        return tiles.met_in_groups(self.pairs, (self.first if first is None else first).drop("cell", "reach"), second, (self.groups[0], self.groups[-1]), run, shape)


def _near(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure): where the cosine of rows of a and b, of single precision, can reach ``least``; where not ``sure``, the doubles decide."""
    slack = (a.shape[1] + 16) * 2.0**-23  # above the rounding of a product of unit vectors
    product = a @ b.T
    i, j = np.nonzero(product >= np.float32(least - slack))
    return i, j, product[i, j] >= np.float32(least + slack)


def _products(min_cosine: float, both: bool):
    """Pairs of rows of tiles: (a, b, cosine) at or above the threshold; ``both`` if the tiles are of one table, so that a < b."""

    def run(table: pa.RecordBatch, todo: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for p, q in todo:
            (ids_a, m_a), (ids_b, m_b) = tiles.values(table, p, ""), tiles.values(table, q, "")
            cosine = m_a @ m_b.T
            i, j = np.nonzero(cosine >= min_cosine)
            a, b, c = ids_a[i], ids_b[j], cosine[i, j]
            keep = (a < b) if both and p == q else (a != b)
            a, b, c = a[keep], b[keep], c[keep]
            if both:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    return run


def similar_pairs(vectors: DataFrame, min_cosine: float, n_pivots: int = 64, queries: Column | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs of item vectors at or above ``min_cosine``: exact, for one vector of equal size an item. With ``queries`` (a
    condition), a runs over those items and b over all others; without, every pair comes once with a < b.

    Each vector lives in the cell of its nearest pivot, packed into tiles, and a meeting of two tiles is one matrix product. The tighter the
    threshold and the more clustered the vectors, the fewer tiles meet; vectors without structure meet tile by tile, each stored once."""
    centers = pivots(vectors, n_pivots)
    if not centers:
        return vectors.select(F.col("item_id").cast("long").alias("a"), F.col("item_id").cast("long").alias("b"), F.lit(0.0).alias("cosine")).limit(0)
    return Meetings(vectors, min_cosine, centers, queries).met(_products(min_cosine, queries is None), "a long, b long, cosine double")


def _degrees(min_cosine: float):
    """(item_id, n): neighbours of each item among those that it meets in a call."""

    def run(table: pa.RecordBatch, todo: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = sorted({x for pair in todo for x in pair})
        held = {x: tiles.values(table, x, "") for x in rows}
        single = {x: held[x][1].astype(np.float32) for x in rows}
        n = {x: np.zeros(len(held[x][0]), np.int64) for x in rows}
        for p, q in todo:
            (ids_a, a), (ids_b, b) = held[p], held[q]
            i, j, sure = _near(single[p], single[q], min_cosine)
            sure[~sure] = (a[i[~sure]] * b[j[~sure]]).sum(axis=1) >= min_cosine
            sure &= ids_a[i] != ids_b[j]
            n[p] += np.bincount(i[sure], minlength=len(a))
            if p != q:
                n[q] += np.bincount(j[sure], minlength=len(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held[x][0] for x in rows])), pa.array(np.concatenate([n[x] for x in rows]))], names=["item_id", "n"])

    return run


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the numbers a with the numbers b in ``root``, in which each number points to the smallest of its set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


LINKS = "a long, b long, cosine double, core long"


def _links(min_cosine: float, common: int):
    """Rows (a, b): cores' clusters that a link unites, as a forest. Rows (a, null, cosine, core): the nearest core of an item that is none.
    Tiles have labels, the cluster so far of each core and null for other items; links inside the cluster ``common`` are not looked at."""

    def run(table: pa.RecordBatch, todo: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = sorted({x for pair in todo for x in pair})
        held = {x: tiles.values(table, x, "") for x in rows}
        marks = {x: (table.column("core")[x].values.to_numpy(zero_copy_only=False), table.column("label")[x].values.to_numpy()) for x in rows}
        odd = {x: np.flatnonzero(~marks[x][0] | (marks[x][1] != common)) for x in rows}
        single = {x: held[x][1].astype(np.float32) for x in rows}
        names = np.unique(np.concatenate([[common], *(marks[x][1] for x in rows)]))
        root = np.arange(len(names))
        best = {x: (np.full(len(held[x][0]), -np.inf), np.zeros(len(held[x][0]), np.int64)) for x in rows}
        # an item that isn't common meets all others of the other tile; of two that are not, one way is enough
        for p, q in todo:
            for x, y in ((p, q),) if p == q else ((p, q), (q, p)):
                at = odd[x]
                if not len(at):
                    continue
                (ids_a, a), (ids_b, b), (core_a, label_a), (core_b, label_b) = held[x], held[y], marks[x], marks[y]
                i, j, sure = _near(single[x][at], single[y], min_cosine)
                i = at[i]
                fine = core_b[j] & (ids_a[i] != ids_b[j]) & ~(core_a[i] & (label_a[i] == label_b[j]))
                i, j, sure = i[fine], j[fine], sure[fine]
                exact = np.ones(len(i))
                ask = ~sure | ~core_a[i]
                exact[ask] = (a[i[ask]] * b[j[ask]]).sum(axis=1)
                fine = sure | (exact >= min_cosine)
                i, j, exact = i[fine], j[fine], exact[fine]
                link = core_a[i]
                if link.any():
                    _united(root, np.searchsorted(names, label_a[i[link]]), np.searchsorted(names, label_b[j[link]]))
                i, j, exact = i[~link], ids_b[j[~link]], exact[~link]
                order = np.lexsort((j, -exact, i))
                first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                c, to = best[x]
                i, j, exact = i[first], j[first], exact[first]
                nearer = (exact > c[i]) | ((exact == c[i]) & (j < to[i]))
                c[i[nearer]], to[i[nearer]] = exact[nearer], j[nearer]
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]]), pa.nulls(len(moved), pa.float64()), pa.nulls(len(moved), pa.int64())], names=["a", "b", "cosine", "core"])
        for x in rows:
            (ids, _), (c, to) = held[x], best[x]
            near = np.isfinite(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.nulls(int(near.sum()), pa.int64()), pa.array(c[near]), pa.array(to[near])], names=["a", "b", "cosine", "core"])

    return run


def _inside(min_cosine: float):
    """mapInArrow over tiles with their cores: (a, b), links that make a forest of each tile's cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v = tiles.values(batch, row, "")
                core = batch.column("core")[row].values.to_numpy(zero_copy_only=False)
                ids, v = ids[core], v[core]
                order = np.argsort(ids)
                ids, v = ids[order], v[order]
                i, j = np.nonzero(v @ v.T >= min_cosine + 1e-9)  # what is so near the threshold is looked at later
                root = np.arange(len(ids))
                _united(root, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["a", "b"])

    return run


def density_clusters(vectors: DataFrame, min_cosine: float, min_points: int = 5) -> DataFrame:
    """(item_id, cluster): items with ``min_points`` neighbours (themselves included) are cores; cores that are neighbours share a cluster,
    named by its smallest core; other items join their nearest core's cluster, or -1 (noise). Items without a vector are noise.

    No pair of items is written: tiles meet once to count neighbours, and once to unite the cores' clusters of each tile and to find the nearest cores of other items."""
    centers = pivots(vectors, 64)
    if not centers:
        return vectors.select("item_id").distinct().select("item_id", F.lit(-1).cast("long").alias("cluster"))
    meetings = Meetings(vectors, min_cosine, centers)
    n = meetings.met(_degrees(min_cosine), "item_id long, n long").groupBy("item_id").agg((F.sum("n") + 1).alias("n"))
    cores = stored(n.select("item_id", (F.col("n") >= min_points).alias("core")), "cores")
    place = meetings.first.select("tile", F.posexplode("ids").alias("pos", "item_id"))

    def marked(marks: DataFrame, *columns: str) -> DataFrame:
        """The tiles with columns of their items, in the items' order."""
        lists = place.join(marks, "item_id").groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("s"))
        return meetings.first.join(lists.select("tile", *[F.transform("s", lambda s: s[c]).alias(c) for c in columns]), "tile")  # noqa: B023

    own = components(marked(cores, "core").select("tile", "ids", "v", "core").mapInArrow(_inside(min_cosine), "a long, b long"))
    early = stored(cores.join(own.withColumnRenamed("node", "item_id"), "item_id", "left").select("item_id", "core", F.coalesce("component", "item_id").alias("label")), "labels")
    most = early.where("core").groupBy("label").count().orderBy(F.desc("count"), "label").first()
    if most is None:
        return vectors.select("item_id").distinct().select("item_id", F.lit(-1).cast("long").alias("cluster"))
    found = stored(meetings.met(_links(min_cosine, most.label), LINKS, marked(early, "core", "label")), "links")
    late = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("label"), "component")
    named = stored(early.where("core").join(late, "label", "left").select(F.col("item_id").alias("core"), F.coalesce("component", "label").alias("cluster")), "named")
    border = found.where("b is null").groupBy(F.col("a").alias("item_id")).agg(F.max(F.struct("cosine", (-F.col("core")).alias("c"))).alias("m")).select("item_id", (-F.col("m.c")).alias("core"))
    joined = border.join(named, "core").select("item_id", "cluster").union(named.select(F.col("core"), "cluster"))
    return vectors.select("item_id").distinct().join(joined, "item_id", "left").select("item_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def dedup_groups(items: DataFrame, hash_col: str, title_col: str, vectors: DataFrame | None = None, min_cosine: float = 0.92) -> DataFrame:
    """(item_id, group_id) of items linked by equal content hashes or equal normalized titles, through star edges to the first of each key,
    and with ``vectors`` (item_id, embedding) also by a cosine of ``min_cosine`` or more, at every size; singletons don't come out."""
    edges = None
    for col in (hash_col, title_col):
        first = items.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(col).agg(F.min("item_id").alias("b"))
        e = items.join(first, col).select(F.col("item_id").alias("a"), "b")
        edges = e if edges is None else edges.union(e)
    if vectors is not None:
        edges = edges.union(similar_pairs(vectors.join(items.select("item_id"), "item_id", "left_semi"), min_cosine).select("a", "b"))
    return components(edges).select(F.col("node").alias("item_id"), F.col("component").alias("group_id"))


def first_of_group(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """The best row of each group; rows without a group all stay."""
    joined = scored.join(groups, "item_id", "left").withColumn("key", F.coalesce(F.concat(F.lit("g"), "group_id"), F.concat(F.lit("i"), "item_id")))
    return joined.groupBy("key").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("s")).select("s.item_id", "s.score")
