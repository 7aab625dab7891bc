"""Quality classifier as a sparse rule ensemble: tree paths become conjunctive rules, a lasso logistic fit weighs them,
and the weighted rules are compiled into one Spark column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.textstats import FEATURES, class_counts, fit_frame, fold, with_stats

#: A rule is a set of (feature number, above, threshold).
Path = tuple[tuple[int, bool, float], ...]


def _holds(path: Path, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, t in path:
        out &= x[:, f] > t if above else x[:, f] <= t
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, depth: int, path: Path, out: list[tuple[Path, float]], least: int) -> None:
    """Newton boosting tree on gradient g and curvature h; every node but the root is a rule; leaves carry their step."""
    best: tuple[float, int, float] | None = None
    whole = g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for f in features:
            at = np.searchsorted(cuts[f], x[:, f], side="left")
            size = len(cuts[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(at, w, size))[:-1] for w in (g, h, None))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain = np.where((ns >= least) & (len(g) - ns >= least), gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), int(f), float(cuts[f][k])
    if best is None:
        out.append((path, float(-g.sum() / (h.sum() + 1))))
        return
    _, f, t = best
    left = x[:, f] <= t
    for side, above in ((left, False), (~left, True)):
        if depth > 1:
            out.append(((*path, (f, above, t)), 0.0))
        _grow(x[side], g[side], h[side], cuts, features, depth - 1, (*path, (f, above, t)), out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Path]:
    """Distinct root-to-node paths of small boosted trees, each grown on half of the rows and two thirds of the features."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = rng.random(len(y)) < 0.5
        features = np.sort(rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False))
        out: list[tuple[Path, float]] = []
        _grow(x[rows], (weight * (p - y))[rows], (weight * p * (1 - p))[rows], cuts, features, depth, (), out, max(5, len(y) // 200))
        for path, step in out:
            if path:
                found[tuple(sorted(path))] = True
                if step:
                    score[_holds(path, x)] += rate * step
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a weighted logistic fit with an L1 penalty, by accelerated proximal gradient steps."""
    w, b = np.zeros(z.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    total = weight.sum()
    step = 4 / (float((weight[:, None] * z**2).sum(axis=0).max()) / total * max(1, z.sum(axis=1).max()) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        d = weight * (p - y) / total
        new = v - step * (z.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * d.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Path, float], ...]

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[FEATURES].to_numpy(dtype=float)
        s = np.full(len(x), self.intercept)
        for path, w in self.rules:
            s += w * _holds(path, x)
        return 1 / (1 + np.exp(-s))

    def column(self) -> Column:
        """The score as one JVM expression over the statistics' columns."""
        total: Column = F.lit(self.intercept)
        for path, w in self.rules:
            cond = None
            for f, above, t in path:
                one = F.col(FEATURES[f]) > t if above else F.col(FEATURES[f]) <= t
                cond = one if cond is None else cond & one
            total = total + F.when(cond, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(frame: pd.DataFrame, counts: tuple[int, int], penalty: float = 0.002) -> Ensemble:
    """Fits on the sample with rows weighed to the class counts of all labelled training rows. One class only, or no rows at
    all: a constant score (the smoothed share of label 1)."""
    y = frame.y.to_numpy(dtype=float)
    share = (counts[1] + 1) / (sum(counts) + 2)
    if not len(y) or y.min() == y.max():
        return Ensemble(float(np.log(share / (1 - share))), ())
    x = frame[FEATURES].to_numpy(dtype=float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    paths = tree_rules(x, y, weight)
    z = np.stack([_holds(p, x) for p in paths], axis=1).astype(float)
    b, w = lasso_logistic(z, y, weight, penalty)
    return Ensemble(b, tuple((p, float(v)) for p, v in zip(paths, w) if abs(v) > 1e-4))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of ``docs``; labels and metadata are never inputs of a score.

    Fitted on at most ``most`` labelled rows of each class outside the held-out fold (the bound on what reaches the driver).
    Null texts score as empty ones. A null id is never held out. Repeated rows each get their row, repeated labels of an id count once. Other columns of both
    tables are ignored, whatever their names; an empty table gives an empty result, and without labels every score is the same.
    """
    model = fit(fit_frame(docs, labels, "quality", folds, held, most), class_counts(docs, labels, "quality", folds, held))
    scored = with_stats(docs).withColumn("score", model.column())
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
