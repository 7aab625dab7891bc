"""HDBSCAN over item vectors: core distances, a minimum spanning tree of mutual reachability by Boruvka rounds, and the condensed tree's stablest clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.graph import components
from docloom.operators.tiles import centres_of, groups_of, met_in_groups, near_pairs, tiled, values
from docloom.sources.shared import stored

#: Neighbours that are listed for each item, at least; more lists settle more Boruvka rounds without a pass over vectors.
LISTED = 16
#: Distances below this count as this, so that densities of copies stay finite.
LEAST = 1e-12


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row, from differences: equal whichever pass computes them."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _nearest(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d) of the k nearest others of each vector of a within its bound."""
    far = distances(a, b)
    far[ids_a[:, None] == ids_b[None, :]] = np.inf
    k = min(k, far.shape[1])
    best = np.argpartition(far, k - 1, axis=1)[:, :k]
    i, j = np.repeat(np.arange(len(a)), k), best.ravel()
    keep = far[i, j] <= bound[i] * (1 + 1e-6) + 1e-6
    i, j = i[keep], j[keep]
    return ids_a[i], ids_b[j], exact(a[i], b[j])


class Lists:
    """The k nearest others of each vector of a tile, ties by id, of all tiles that it is held against. Vectors beyond a bound aren't listed."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.ids, self.v, self.k, self.limit = ids, v, k, bound.copy()
        self.i, self.d, self.b = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.single, self.squares = v.astype(np.float32), (v**2).sum(axis=1)

    def meet(self, other: Lists) -> None:
        least = (self.squares[:, None] - self.limit[:, None] ** 2 * (1 + 1e-6)).astype(np.float32)
        # above the rounding of a product of single precision; what is left is computed again from differences
        slack = (self.v.shape[1] + 16) * 2.0**-21 * (self.squares.max(initial=0) + other.squares.max(initial=0))
        near = self.single @ (2 * other.single.T) - other.squares.astype(np.float32) >= least - np.float32(slack)
        if np.count_nonzero(near) > 4 * self.k * len(self.v):
            a, b, d = _nearest(np.arange(len(self.v)), self.v, -1 - np.arange(len(other.v)), other.v, self.k, self.limit)
            i, b = a, other.ids[-1 - b]
        else:
            i, j = np.nonzero(near)
            b, d = other.ids[j], exact(self.v[i], other.v[j])
        i, d, b = (np.concatenate(x) for x in ((self.i, i), (self.d, d), (self.b, b)))
        order = np.lexsort((b, d, i))
        i, d, b = i[order], d[order], b[order]
        at = np.arange(len(i)) - np.searchsorted(i, i)
        full = at == self.k - 1
        self.limit[i[full]] = np.minimum(self.limit[i[full]], d[full])
        self.i, self.d, self.b = (x[at < self.k] for x in (i, d, b))


NEIGHBOURS = "a long, b long, d double"


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def neighbours(tiles: DataFrame, groups: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """(a, b, d): the k nearest other items of each item, exact. The lists within a tile bound how far the others can be, and with that which tiles meet."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v = values(batch, row, "")
                a, b, d = _nearest(ids, v, ids, v, min(k, len(ids) - 1), np.full(len(ids), np.inf)) if len(ids) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                bound = np.full(len(ids), np.inf)
                if len(ids) > k:
                    order = np.argsort(a, kind="stable")
                    bound[np.argsort(ids, kind="stable")] = d[order].reshape(len(ids), k).max(axis=1)
                at = {x: i for i, x in enumerate(ids.tolist())}
                lists = [[] for _ in ids]
                for x, y, z in zip(a.tolist(), b.tolist(), d.tolist()):
                    lists[at[x]].append({"b": y, "d": z})
                kind = pa.list_(pa.list_(pa.struct([("b", pa.int64()), ("d", pa.float64())])))
                yield pa.RecordBatch.from_arrays([batch.column("tile")[row : row + 1], pa.array([bound.tolist()]), pa.array([lists], kind)], names=["tile", "bound", "lists"])

    def across(table: pa.RecordBatch, todo: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        bound = table.column("bound")
        lists = {row: Lists(*values(table, row, ""), np.asarray(bound[row].values), k) for row in {x for pair in todo for x in pair}}
        for p, q in todo:
            lists[p].meet(lists[q])
        for own in lists.values():
            yield _batch([own.ids[own.i], own.b, own.d], ["a", "b", "d"])

    own = stored(tiles.select("tile", "ids", "v").mapInArrow(inside, "tile long, bound array<double>, lists array<array<struct<b:long,d:double>>>"), "inside")
    meta = tiles.select("tile", "cell", "reach").join(own.select("tile", F.array_max("bound").alias("most")), "tile")
    pairs = near_pairs(meta, meta.drop("most"), centres, lambda least: (F.col("tile_a") != F.col("tile_b")) & (least <= F.col("most_a") * (1 + 1e-6) + 1e-6))
    held = tiles.select("tile", "ids", "v")
    others = met_in_groups(pairs, held.join(own.select("tile", "bound"), "tile"), None, (groups, groups), across, NEIGHBOURS)
    flat = own.join(tiles.select("tile", "ids"), "tile").select(F.explode(F.arrays_zip("ids", "lists")).alias("z")).select(F.col("z.ids").alias("a"), F.explode("z.lists").alias("n")).select("a", "n.b", "n.d")
    best = Window.partitionBy("a").orderBy("d", "b")
    return stored(flat.union(others).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "neighbours")


EDGE = "struct(w, least(a, b) as lo, greatest(a, b) as hi)"


def spanning_tree(tiles: DataFrame, groups: DataFrame, centres: np.ndarray, lists: DataFrame, cores: DataFrame, k: int) -> DataFrame:
    """(w, lo, hi): a minimum spanning tree of mutual reachability, max(distance, core of either end).

    In each round every component takes its lightest edge to another one. The lists give it where no item of the component can have a lighter one beyond its list;
    in a round where they give none, tiles meet, as near as the components' lightest known edges."""
    core = lambda side: cores.select(F.col("item_id").alias(side), F.col("core").alias(f"core_{side}"))
    links = lists.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    links = stored(links, "links")
    # no edge beyond an item's list is lighter than this; a short list is a complete one
    beyond = lists.groupBy("a").agg(F.max("d").alias("far"), F.count("*").alias("n")).join(core("a"), "a")
    beyond = stored(beyond.select("a", F.when(F.col("n") >= k, F.greatest("far", "core_a")).otherwise(F.lit(float("inf"))).alias("beyond")), "beyond")
    of = stored(cores.select(F.col("item_id").alias("node"), F.col("item_id").alias("c")), "of")
    tree: DataFrame | None = None
    while True:
        label = lambda side, frame=of: frame.select(F.col("node").alias(side), F.col("c").alias(f"c_{side}"))
        links = stored(links.select("a", "b", "w").join(label("a"), "a").join(label("b"), "b").where("c_a != c_b"), "links")
        ends = links.select("c_a", "c_b", F.expr(EDGE).alias("e")).union(links.select("c_b", "c_a", F.expr(EDGE).alias("e")))
        light = ends.groupBy(F.col("c_a").alias("c")).agg(F.min(F.struct("e", F.col("c_b").alias("to"))).alias("m"))
        limit = beyond.join(label("a"), "a").groupBy(F.col("c_a").alias("c")).agg(F.min("beyond").alias("limit"))
        state = stored(limit.join(light, "c", "left").select("c", "limit", "m.e", "m.to"), "state")
        n, settled = state.agg(F.count("*"), F.count_if(F.col("e.w") <= F.col("limit"))).first()
        if n <= 1:
            break
        chosen = state.where(F.col("e.w") <= F.col("limit")).select("c", "e", "to") if settled else _lightest(tiles, groups, centres, cores, of, state)
        chosen = stored(chosen, "chosen")
        step = chosen.select("e.w", "e.lo", "e.hi").distinct()
        tree = step if tree is None else tree.union(step)
        named = components(chosen.select(F.col("c").alias("a"), F.col("to").alias("b")))
        of = stored(of.join(named.withColumnRenamed("node", "c"), "c", "left").select("node", F.coalesce("component", "c").alias("c")), "of")
    return cores.select(F.lit(0.0).alias("w"), F.col("item_id").alias("lo"), F.col("item_id").alias("hi")).limit(0) if tree is None else tree


def _lightest(tiles: DataFrame, groups: DataFrame, centres: np.ndarray, cores: DataFrame, of: DataFrame, state: DataFrame) -> DataFrame:
    """(c, e, to): the lightest edge of every component by meetings of tiles; known edges bound which tiles meet."""
    place = tiles.select("tile", F.posexplode("ids").alias("pos", "node")).join(of, "node").join(cores.withColumnRenamed("item_id", "node"), "node")
    place = place.join(state.select("c", F.coalesce("e.w", F.lit(float("inf"))).alias("known")), "c")
    marks = place.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "core"))).alias("s"), F.max("known").alias("most"), F.min("core").alias("core"), F.min("c").alias("low"), F.max("c").alias("high"))
    marks = stored(marks.select("tile", "most", "core", "low", "high", F.transform("s", lambda s: s["c"]).alias("cs"), F.transform("s", lambda s: s["core"]).alias("cores")), "marks")
    meta = tiles.select("tile", "cell", "reach").join(marks.drop("cs", "cores"), "tile")
    one = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b")) & (F.col("low_a") == F.col("low_b"))
    can = lambda least: (F.col("tile_a") <= F.col("tile_b")) & ~one & (F.greatest(least, F.col("core_a"), F.col("core_b")) <= F.greatest("most_a", "most_b") * (1 + 1e-6) + 1e-6)
    pairs = near_pairs(meta, meta, centres, can)
    held = tiles.select("tile", "ids", "v").join(marks.select("tile", "cs", "cores"), "tile")

    def first(c: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
        """The lightest edge of each component."""
        order = np.lexsort((hi, lo, w, c))
        order = order[np.flatnonzero(np.diff(c[order], prepend=np.int64(-(1 << 62))))] if len(order) else order
        return [x[order] for x in (c, w, lo, hi, to)]

    def run(table: pa.RecordBatch, todo: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, t) for t in (np.int64, float, np.int64, np.int64, np.int64)]
        for p, q in todo:
            (ids_a, a), (ids_b, b) = values(table, p, ""), values(table, q, "")
            (cs_a, core_a), (cs_b, core_b) = ([np.asarray(table.column(name)[row].values) for name in ("cs", "cores")] for row in (p, q))
            reach = np.maximum(distances(a, b), np.maximum(core_a[:, None], core_b[None, :]))
            reach[cs_a[:, None] == cs_b[None, :]] = np.inf
            # of each row and of each column the lightest edges, near ties included: their weights are computed again from differences
            edge = np.zeros(reach.shape, dtype=bool)
            edge |= reach <= reach.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-9
            edge |= reach <= reach.min(axis=0, keepdims=True) * (1 + 1e-9) + 1e-9
            i, j = np.nonzero(edge & np.isfinite(reach))
            w = np.maximum(exact(a[i], b[j]), np.maximum(core_a[i], core_b[j]))
            lo, hi = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
            found = [np.concatenate([cs_a[i], cs_b[j]]), *(np.concatenate([x, x]) for x in (w, lo, hi)), np.concatenate([cs_b[j], cs_a[i]])]
            best = first(*(np.concatenate(x) for x in zip(best, found)))
        yield _batch(best, ["c", "w", "lo", "hi", "to"])

    found = met_in_groups(pairs, held, None, (groups, groups), run, "c long, w double, lo long, hi long, to long")
    return found.groupBy("c").agg(F.min(F.struct(F.struct("w", "lo", "hi").alias("e"), "to")).alias("m")).select("c", "m.e", "m.to")


def labels(w: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, min_size: int) -> np.ndarray:
    """Cluster of each of n points, -1 for noise, from the edges of their spanning tree (points are 0 to n - 1)."""
    # single linkage: node n + k joins two nodes at the k-th lightest edge
    root, child, size, level = list(range(2 * n)), [], [1] * n, []
    for k in np.lexsort((b, a, w)):
        ends = []
        for x in (int(a[k]), int(b[k])):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            ends.append(x)
        if ends[0] != ends[1]:
            node = n + len(child)
            root[ends[0]] = root[ends[1]] = node
            child.append(ends)
            size.append(size[ends[0]] + size[ends[1]])
            level.append(1 / max(float(w[k]), LEAST))
    # condensed from the top: a split with two sides of min_size makes two clusters, a smaller side falls out of the one it is in
    top = n + len(child) - 1
    cluster, fallen = [0] * (top + 1), [0.0] * (top + 1)
    parent, born, stability = [-1], [0.0], [0.0]
    for node in range(top, n - 1, -1):
        sides, here = child[node - n], cluster[node]
        if fallen[node]:
            for s in sides:
                cluster[s], fallen[s] = here, fallen[node]
            continue
        now = level[node - n]
        big = [s for s in sides if size[s] >= min_size]
        for s in sides:
            cluster[s] = here
            if len(big) == 2:
                cluster[s] = len(parent)
                parent.append(here)
                born.append(now)
                stability.append(0.0)
            elif s not in big:
                fallen[s] = now
            if len(big) == 2 or s not in big:
                stability[here] += size[s] * (now - born[here])
    # the most stable of a cluster and what it split into; the root alone isn't a cluster
    below, taken = [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        taken[c] = stability[c] >= below[c]
        below[parent[c]] += max(stability[c], below[c])
    name = [-1] * len(parent)
    for c in range(1, len(parent)):
        name[c] = name[parent[c]] if name[parent[c]] >= 0 else c if taken[c] else -1
    return np.array([name[cluster[i]] for i in range(n)], dtype=np.int64)


def hdbscan(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int = 5, min_items: int = 20) -> DataFrame:
    """(item_id, cluster): density clusters of item vectors (item_id long, embedding) by Euclidean distance, named by their smallest item; -1 is noise.

    The core distance of an item is that to its ``min_samples``-th nearest one, itself being the first. Clusters are chosen by excess of mass, and all items in one
    cluster are none. Fewer than ``min_items`` items are all noise; vectors of different sizes raise, as mixed models can't be compared; null ids and null vectors
    are left out, of rows that repeat an id the smallest vector counts.

    Neighbours and Boruvka rounds are joins and tile products, as many as the vectors' structure asks for (without any, all tiles meet). The tree has one edge an
    item; its condensation is a sequence over them, which one task goes through with some 200 bytes an item: that bounds the items of a call to some ten millions.
    """
    v = F.col("embedding").cast("array<double>")
    once = vectors.where(F.col("item_id").isNotNull() & F.col("embedding").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(v).alias("v"))
    once = stored(once, "vectors")
    n, least, most = once.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and least != most:
        raise ValueError(f"embedding sizes differ: {least} to {most}")
    if n < max(min_items, 2):
        return once.select("item_id", F.lit(-1).cast("long").alias("cluster"))
    k = max(LISTED, min_samples)
    centres = centres_of(once, n)
    tiles = tiled(once, centres)
    groups = groups_of(tiles, centres.shape[1])
    lists = neighbours(tiles, groups, centres, k)
    nth = F.max(F.when(F.col("r") <= max(min_samples - 1, 0), F.col("d")))
    cores = stored(lists.groupBy(F.col("a").alias("item_id")).agg(F.coalesce(nth, F.lit(0.0)).alias("core")), "cores")
    tree = spanning_tree(tiles, groups, centres, lists, cores, k)

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(c) for c in batch.columns] for batch in batches if batch.num_rows]
        if parts:
            w, lo, hi = (np.concatenate(x) for x in zip(*parts))
            ids = np.unique(np.concatenate([lo, hi]))
            found = labels(w, np.searchsorted(ids, lo), np.searchsorted(ids, hi), len(ids), min_cluster_size)
            first: dict[int, int] = {}
            for item, c in zip(ids.tolist(), found.tolist()):
                first.setdefault(c, item)
            yield _batch([ids, np.array([-1 if c < 0 else first[c] for c in found.tolist()], dtype=np.int64)], ["item_id", "cluster"])

    return tree.coalesce(1).mapInArrow(condense, "item_id long, cluster long")
