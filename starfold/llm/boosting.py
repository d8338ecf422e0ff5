"""Gradient-boosted trees over counted cells of small integer features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature values, positives, negatives): all rows that share their features.
Cell = tuple[tuple[int, ...], float, float]


@dataclass
class Tree:
    """``feature < cut`` goes left; a leaf has only a value."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def score(self, x: Sequence[int]) -> float:
        node = self
        while node.left is not None:
            node = node.left if x[node.feature] < node.cut else node.right
        return node.value

    def column(self, fields: Sequence[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(fields[self.feature] < self.cut, self.left.column(fields)).otherwise(self.right.column(fields))


@dataclass
class Boosted:
    """Logistic model: prior log-odds and trees."""

    prior: float
    trees: list[Tree]

    def score(self, x: Sequence[int]) -> float:
        return self.prior + sum(t.score(x) for t in self.trees)

    def column(self, fields: Sequence[Column]) -> Column:
        return sum((t.column(fields) for t in self.trees), F.lit(self.prior))


def _grow(rows: list[tuple[Sequence[int], float, float]], depth: int, rate: float, ridge: float) -> Tree:
    """Newton tree on (features, gradient, weight)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    here = Tree(rate * g / (h + ridge))
    best = (1e-6, -1, 0)
    if depth:
        for f in range(len(rows[0][0])):
            by: dict[int, list[float]] = {}
            for x, a, b in rows:
                s = by.setdefault(x[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            lg = lh = 0.0
            values = sorted(by)
            for v, after in zip(values, values[1:]):
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
                if gain > best[0]:
                    best = (gain, f, after)
    if best[1] < 0:
        return here
    _, here.feature, here.cut = best
    here.left = _grow([r for r in rows if r[0][here.feature] < here.cut], depth - 1, rate, ridge)
    here.right = _grow([r for r in rows if r[0][here.feature] >= here.cut], depth - 1, rate, ridge)
    return here


def boost(cells: Sequence[Cell], rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Fit to the counted cells; the same as on the rows behind them. Without cells the score is -5."""
    cells = sorted(cells)
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Boosted(math.log((pos + 0.5) / (neg + 0.5)) if cells else -5.0, [])
    at = [model.prior] * len(cells)
    for _ in range(rounds if pos and neg else 0):
        rows = []
        for (x, p, n), s in zip(cells, at):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            rows.append((x, p - (p + n) * q, (p + n) * q * (1 - q)))
        tree = _grow(rows, depth, rate, ridge)
        model.trees.append(tree)
        at = [s + tree.score(c[0]) for s, c in zip(at, cells)]
    return model


def threshold(model: Boosted, cells: Sequence[Cell], precision: float) -> float:
    """Lowest score from which on the share of positives, smoothed by one negative, stays at
    ``precision``; infinite if no score does."""
    by: Mapping[float, list[float]] = {}
    for x, p, n in cells:
        s = by.setdefault(round(model.score(x), 9), [0.0, 0.0])
        s[0] += p
        s[1] += n
    best, p, n = math.inf, 0.0, 1.0
    for s in sorted(by, reverse=True):
        p, n = p + by[s][0], n + by[s][1]
        if p / (p + n) >= precision:
            best = s - 1e-6
    return best
