"""Density clusters against all pairs, and what their meetings of tiles move and write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import graph, tiles


def plain(ids, points, least, min_points):
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = u @ u.T >= least
    core = near.sum(axis=1) >= min_points
    of = {i: i for i in range(len(ids))}
    before = None
    while of != before:
        before, of = of, {i: min(of[j] for j in range(len(ids)) if near[i, j] and core[j]) if core[i] else i for i in of}
    out = {}
    for i, x in enumerate(ids):
        at = [(-round(float(u[i] @ u[j]), 12), ids[j], of[j]) for j in range(len(ids)) if core[j] and near[i, j]]
        out[x] = ids[of[i]] if core[i] else ids[min(at)[2]] if at else -1
    return out


@pytest.mark.parametrize("tile, groups, spread, min_points", [(16, 3, 0.35, 4), (8, 4, 0.5, 6)])
def test_clusters_match_all_pairs(spark, monkeypatch, tile, groups, spread, min_points):
    monkeypatch.setattr(graph, "TILE", tile)
    monkeypatch.setattr(tiles, "GROUPS", groups)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 6))
    points = np.array([base[i % 9] + rng.normal(size=6) * spread for i in range(160)] + [base[0]] * 5)
    ids = [int(x) for x in rng.permutation(1000)[: len(points)]]
    order = np.argsort(ids)
    ids, points = [ids[i] for i in order], points[order]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, points)] + [(2000, [0.0] * 6), (2001, None)], "item_id long, embedding array<double>").repartition(3)
    got = {r.item_id: r.cluster for r in graph.density_clusters(frame, 0.9, min_points).collect()}
    assert got == plain(ids, points, 0.9, min_points) | {2000: -1, 2001: -1}


def test_a_meeting_of_groups_moves_a_tile_once(spark, monkeypatch):
    """Sixteen tiles that all meet, in four groups: each comes to the four pairs that its group is in, not to sixteen pairs of tiles."""
    monkeypatch.setattr(tiles, "GROUPS", 4)
    held = spark.createDataFrame([(t, 0, [t], [float(t)]) for t in range(16)], "tile long, cell int, ids array<long>, v array<double>")
    pairs = held.select(F.col("tile").alias("a")).crossJoin(held.select(F.col("tile").alias("b"))).where("a <= b")

    def seen(table, todo):
        import pyarrow as pa

        ids = [table.column("ids")[i].as_py() for i in range(table.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([len([x for x in ids if x])], pa.int64()), pa.array([len(todo)], pa.int64())], names=["moved", "met"])

    group = tiles.groups_of(held, 1)
    r = tiles.met_in_groups(pairs, held.drop("cell"), None, (group, group), seen, "moved long, met long").agg(F.sum("moved"), F.sum("met"), F.count("*")).first()
    assert tuple(r) == (16 * 4, 16 * 17 // 2, 4 * 5 // 2)
