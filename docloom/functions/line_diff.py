"""Line diff in the time of the lines and the square of the edits: furthest reaches from the end, kept at every few levels, then one walk from the start."""

from __future__ import annotations

import numpy as np

#: Levels between two that are kept; those between are computed again when the walk gets there.
KEPT_EVERY = 64


def _run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """Length of the common run of a from x and of b from y, by steps that double."""
    length, step = 0, 16
    while True:
        n = min(step, len(a) - x - length, len(b) - y - length)
        if n <= 0:
            return length
        apart = np.flatnonzero(a[x + length : x + length + n] != b[y + length : y + length + n])
        if len(apart):
            return length + int(apart[0])
        length, step = length + n, step * 2


def _next_level(a: np.ndarray, b: np.ndarray, before: np.ndarray | None, d: int) -> np.ndarray:
    """Furthest reach in a on each diagonal -d, -d + 2, ..., d with d edits; -1 where none is. On diagonal k the reach in b is that in a minus k."""
    n, m = len(a), len(b)
    k = np.arange(-d, d + 1, 2)
    if before is None:
        x = np.zeros(1, dtype=np.int64)
    else:
        gap = np.full(1, -1, dtype=np.int64)
        right = np.concatenate([gap, before])
        right = np.where((right >= 0) & (right < n), right + 1, -1)
        down = np.concatenate([before, gap])
        down = np.where((down >= 0) & (down - k <= m), down, -1)
        x = np.maximum(right, down)
    y = x - k
    on = np.flatnonzero((x >= 0) & (x < n) & (y < m))
    for i in on[a[x[on]] == b[y[on]]]:
        x[i] += _run(a, b, int(x[i]), int(y[i]))
    return x


class Levels:
    """Furthest reaches by number of edits, over two sequences from their starts."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, self.kept, self.block = a, b, {}, {}
        level, d = None, 0
        while True:
            level = _next_level(a, b, level, d)
            if d % KEPT_EVERY == 0:
                self.kept[d] = level
            at = (len(a) - len(b) + d) // 2
            if (len(a) - len(b) + d) % 2 == 0 and 0 <= at <= d and level[at] >= len(a):
                break
            d += 1
        self.edits = d

    def reach(self, d: int, k: int) -> int:
        if d not in self.block:
            first = d - d % KEPT_EVERY
            self.block = {first: self.kept[first]}
            for e in range(first + 1, d + 1):
                self.block[e] = _next_level(self.a, self.b, self.block[e - 1], e)
        at = (k + d) // 2
        return int(self.block[d][at]) if abs(k) <= d else -1


def steps(a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, from, to) runs that turn a into b over a longest common subsequence: equal and delete count in a, insert in b. Equal elements are always taken, and of a
    deletion and an insertion that are as good the deletion comes first."""
    n, m = len(a), len(b)
    levels = Levels(a[::-1], b[::-1])
    out: list[tuple[str, int, int]] = []

    def put(kind: str, at: int, count: int) -> None:
        if out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], at + count)
        else:
            out.append((kind, at, at + count))

    i = j = 0
    d = levels.edits
    while i < n or j < m:
        same = _run(a, b, i, j)
        if same:
            put("equal", i, same)
            i, j = i + same, j + same
            continue
        x, k = n - i, (n - i) - (m - j)
        # what is left after a deletion takes one edit less if it lies within the reach of so many
        if i < n and (j == m or x - 1 <= levels.reach(d - 1, k - 1)):
            put("delete", i, 1)
            i += 1
        else:
            put("insert", j, 1)
            j += 1
        d -= 1
    return out


def line_hunks(a: str, b: str) -> list[dict]:
    """Equal, deleted and inserted runs of lines by a longest common subsequence; ties advance the first text."""
    x, y = a.split("\n"), b.split("\n")
    seen: dict[str, int] = {}
    ids = [np.fromiter((seen.setdefault(line, len(seen)) for line in lines), np.int64, len(lines)) for lines in (x, y)]
    return [{"kind": kind, "text": "\n".join((y if kind == "insert" else x)[start:end])} for kind, start, end in steps(*ids)]
