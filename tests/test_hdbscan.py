"""HDBSCAN against a version from the definitions: all pairs sorted, clusters as sets."""

import numpy as np
import pytest

from docloom.operators import hdbscan, tiles


def plain(points, min_size, min_samples):
    """The chosen clusters as sets of row numbers. Equal weights go by the rows' numbers."""
    n = len(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(far, axis=1)[:, min_samples - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    of, edges = list(range(n)), []
    for w, a, b in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if of[a] != of[b]:
            edges.append((w, a, b))
            old, new = of[a], of[b]
            of = [new if x == old else x for x in of]

    def reached(start, within, links):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for _, a, b in links:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y in within and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    def chosen(points, links, born, root):
        """(stability, clusters) of what is best at or below a cluster."""
        members, left, links, stable = set(points), set(points), sorted(links), 0.0
        while links:
            w, a, b = links.pop()
            density = 1 / max(w, 1e-12)
            one = reached(a, left, links)
            other = left - one
            small = [s for s in (one, other) if len(s) < min_size]
            if len(small) != 1:
                stable += len(left) * (density - born)
                parts = [] if small else [chosen(s, [x for x in links if x[1] in s], density, False) for s in (one, other)]
                below = sum(s for s, _ in parts)
                if not root and stable >= below:
                    return stable, [members]
                return max(below, 0.0 if root else stable), [c for _, cs in parts for c in cs]
            stable += len(small[0]) * (density - born)
            left -= small[0]
            links = [x for x in links if x[1] in left and x[2] in left]
        return stable, [] if root else [members]

    return sorted(map(sorted, chosen(range(n), edges, 0.0, True)[1]))


def found(frame, **options):
    out = {}
    for r in hdbscan.hdbscan(frame, **options).collect():
        out.setdefault(r.cluster, set()).add(r.item_id)
    return out


def frame_of(spark, points, first=0):
    return spark.createDataFrame([(first + i, p.tolist()) for i, p in enumerate(points)], "item_id long, embedding array<double>").repartition(3)


def blobs(rng, n, kinds, size=6):
    centres = rng.normal(size=(kinds, size)) * 3
    near = [centres[i % kinds] + rng.normal(size=size) * (0.2 + 0.15 * (i % kinds)) for i in range(n - n // 8)]
    return np.array(near + [rng.normal(size=size) * 4 for _ in range(n // 8)])


@pytest.mark.parametrize("n, tile, samples", [(500, 64, 5), (150, 1024, 3)])
def test_clusters_match_the_definitions(spark, monkeypatch, n, tile, samples):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "TILES_A_CELL", 1)
    points = blobs(np.random.default_rng(n), n, 7)
    got = found(frame_of(spark, points), min_samples=samples)
    assert sorted(sorted(v) for k, v in got.items() if k != -1) == plain(points, 5, samples)
    assert all(min(v) == k for k, v in got.items() if k != -1) and set().union(*got.values()) == set(range(n))


def test_labels_of_small_trees():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(8, 60))
        points = np.round(rng.normal(size=(n, 2)) * 2, 1)  # many equal distances
        far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        core = np.sort(far, axis=1)[:, 2]
        reach = np.maximum(far, np.maximum(core[:, None], core[None]))
        order = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
        w, a, b = (np.array(x) for x in zip(*order))  # edges that close a circle are passed over
        got = hdbscan.labels(w, a, b, n, 3)
        assert sorted(np.flatnonzero(got == c).tolist() for c in set(got.tolist()) - {-1}) == plain(points, 3, 3)


def test_two_tight_groups_and_copies(spark):
    two = [np.eye(8)[0] + 0.01 * i * np.eye(8)[1] for i in range(6)] + [np.eye(8)[4] + 0.01 * i * np.eye(8)[5] for i in range(6)]
    assert found(frame_of(spark, two), min_items=12) == {0: set(range(6)), 6: set(range(6, 12))}
    assert found(frame_of(spark, two)) == {-1: set(range(12))}  # fewer than 20 items
    copies = [[1.0, 2.0]] * 30 + [[5.0, 5.0]] * 30 + [[90.0, 90.0]]
    got = found(frame_of(spark, np.array(copies)))
    assert got == {0: set(range(30)), 30: set(range(30, 60)), -1: {60}}


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    assert hdbscan.hdbscan(none).collect() == []
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "item_id long, embedding array<double>")
    with pytest.raises(ValueError, match="sizes differ"):
        hdbscan.hdbscan(mixed)
    odd = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (None, [1.0]), (2, None)], "item_id long, embedding array<double>")
    assert [tuple(r) for r in hdbscan.hdbscan(odd).collect()] == [(1, -1)]


def test_lists_are_the_nearest_of_all_tiles_with_ties_by_id():
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(90, 3)), 1)  # many equal distances
    ids = rng.permutation(1000)[:90]
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    parts = np.split(np.arange(90), [20, 45, 50])
    # a bound as lists inside the tile give it, or none
    for bound in (np.full(20, np.inf), np.sort(far[:20, :20], axis=1)[:, 5]):
        held = [hdbscan.Lists(ids[p], points[p], bound if not i else np.full(len(p), np.inf), 5) for i, p in enumerate(parts)]
        for other in held[1:]:
            held[0].meet(other)
        got = {}
        for i, d, b in zip(held[0].i, held[0].d, held[0].b):
            got.setdefault(int(i), []).append((d, b))
        for i in range(20):
            want = sorted((far[i, j], ids[j]) for j in range(20, 90) if far[i, j] <= bound[i])[:5]
            assert got.get(i, [])[: len(want)] == want


def test_values_move_once_a_pair_of_groups(spark, monkeypatch):
    """Meetings used to shuffle both tiles of every pair: the rows that calls get are counted."""
    seen = []
    plain_meet = hdbscan.met_in_groups

    def counted(pairs, first, second, groups, run, shape):
        tables = plain_meet(pairs, first, second, groups, lambda table, todo: iter([hdbscan._batch([np.array([table.num_rows - 1]), np.array([len(todo)])], ["rows", "pairs"])]), "rows long, pairs long")
        seen.append([tuple(r) for r in tables.collect()])
        return plain_meet(pairs, first, second, groups, run, shape)

    monkeypatch.setattr(hdbscan, "met_in_groups", counted)
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "GROUPS", 3)
    found(frame_of(spark, np.random.default_rng(1).normal(size=(300, 6))))
    rows, pairs = (sum(x) for x in zip(*seen[0]))
    assert rows < pairs / 2
