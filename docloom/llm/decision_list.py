"""Quality rules as a learned decision list: sequential covering with growing and pruning, emitted as ordered conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.textstats import COUNTS, FEATURES, fit_frame, with_stats


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.feature].to_numpy()
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a text as bad, with its precision on the rows it was pruned on."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(frame), dtype=bool)
        for c in self.conditions:
            out &= c.holds(frame)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _best_condition(frame: pd.DataFrame, bad: np.ndarray, weight: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of highest information gain for the bad class among the rows still covered."""
    p0, n0 = weight[bad].sum(), weight[~bad].sum()
    best: tuple[float, Condition | None] = (1e-9, None)
    for name in FEATURES:
        x = frame[name].to_numpy(dtype=float)
        order = np.argsort(x, kind="stable")
        xs, bs, ws = x[order], bad[order], weight[order]
        p, n = np.cumsum(ws * bs), np.cumsum(ws * ~bs)
        cuts = np.flatnonzero(xs[1:] > xs[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            pc, nc = (p0 - p[cuts], n0 - n[cuts]) if above else (p[cuts], n[cuts])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - np.log2(p0 / (p0 + n0))), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = float(gain[k]), Condition(name, above, float((xs[cuts[k]] + xs[cuts[k] + 1]) / 2))
    return best


def learn(frame: pd.DataFrame, min_precision: float = 0.8, min_cover: int = 5, max_conditions: int = 4, max_rules: int = 12) -> list[Rule]:
    """Ordered rules for y = 0 (bad). Each is grown on two thirds of the rows left and pruned on the other third; covering stops
    when a new rule is less precise than ``min_precision`` or covers fewer than ``min_cover`` bad rows there. The conjunction
    that is kept is the prefix with the highest (p - n) / (p + n), the longer one on a tie. No row of either class: no rules."""
    left, rules = frame, []
    while len(rules) < max_rules and (left.y == 0).any() and (left.y == 1).any():
        third = np.arange(len(left)) % 3 == 2
        grow, prune = left[~third], left[third]
        conditions: list[Condition] = []
        while len(conditions) < max_conditions and (grow.y == 1).any() and (grow.y == 0).any():
            _, c = _best_condition(grow, (grow.y == 0).to_numpy(), np.ones(len(grow)))
            if c is None:
                break
            conditions.append(c)
            grow = grow[c.holds(grow)]
        best: tuple[float, int, Rule, int] | None = None
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]), 0.0)
            hit = rule.holds(prune)
            p, n = int((prune.y[hit] == 0).sum()), int((prune.y[hit] == 1).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if best is None or (worth, k) > best[:2]:
                best = worth, k, Rule(rule.conditions, p / (p + n) if p + n else 0.0), p
        if best is None or best[2].precision < min_precision or best[3] < min_cover:
            break
        rules.append(best[2])
        left = left[~best[2].holds(left)]
    return rules


def compile_rules(rules: list[Rule]) -> tuple[Column, Column]:
    """(number of the first rule that holds, from 1; null where none does) and (kept: none holds), as ordered Spark conditions."""
    if not rules:
        return F.lit(None).cast("int"), F.lit(True)
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            cond = cond & c.column()
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out, out.isNull()


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def apply_quality_rules(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = 3000) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule int (null: none), kept, for every row of ``docs``.

    Rules are learned on at most ``most`` labelled rows of each class (a documented bound on what the driver holds), outside the
    held-out fold. Null and empty texts have no words, fail the base rules and aren't kept. Without usable labels the list is
    empty and only the base rules decide. Repeated rows each get their row.
    """
    rule, good = compile_rules(learn(fit_frame(docs, labels, "quality", folds, held, most)))
    stats = with_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule)
    return stats.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & good).alias("kept"))
