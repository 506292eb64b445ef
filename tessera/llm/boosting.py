"""Boosted trees over small integer features, compiled into Spark column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic gradient boosting on a histogram: distinct feature vectors with weights of both classes.

    `fit` takes x (n, f) of small ints and the positive and total weight of each vector, so its cost depends on the
    number of distinct vectors only. `margin_column` turns the trees into nested CASE expressions.
    """

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> BoostedTrees:
        share = (positive.sum() + 0.5) / (total.sum() + 1.0)
        self.bias = math.log(share / (1 - share))
        margin = np.full(len(x), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, positive - total * p, total * p * (1 - p), np.arange(len(x)), self.depth)
            self.trees.append(tree)
            margin += self._values(tree, x)
        return self

    def _grow(self, x, gradient, curvature, at, depth):
        g, h = gradient[at].sum(), curvature[at].sum()
        leaf, best = self.rate * g / (h + self.ridge), (1e-6, None, None)
        for f in range(x.shape[1]) if depth else ():
            values = x[at, f]
            for cut in np.unique(values)[:-1]:
                low = values <= cut
                gl, hl = gradient[at][low].sum(), curvature[at][low].sum()
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                if gain > best[0]:
                    best = (gain, f, int(cut))
        if best[1] is None:
            return leaf
        low = x[at, best[1]] <= best[2]
        branches = (self._grow(x, gradient, curvature, at[m], depth - 1) for m in (low, ~low))
        return (best[1], best[2], *branches)

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), float(tree))
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low], out[~low] = self._values(tree[2], x[low]), self._values(tree[3], x[~low])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self._values(t, x) for t in self.trees), np.full(len(x), self.bias))

    def margin_column(self, feature: Callable[[int], Column]) -> Column:
        """The margin as a column; feature(i) gives the i-th feature's column."""

        def compiled(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(feature(tree[0]) <= tree[1], compiled(tree[2])).otherwise(compiled(tree[3]))

        margin = F.lit(self.bias)
        for tree in self.trees:
            margin = margin + compiled(tree)
        return margin


class Platt:
    """Probability of a margin, σ(slope * margin + shift), fitted to weighted outcomes with smoothed targets."""

    def __init__(self, margin: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 50, ridge: float = 1e-3):
        self.slope, self.shift = 1.0, 0.0
        yes, no = positive.sum(), total.sum() - positive.sum()
        target = positive * (yes + 1) / (yes + 2) + (total - positive) / (no + 2)
        x = np.stack([margin, np.ones(len(margin))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(rounds if total.sum() else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = x.T @ (target - total * p) - ridge * (w - [1.0, 0.0])
            curve = (x * (total * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2)
            w = w + np.clip(np.linalg.solve(curve, step), -1, 1)
        # a falling curve would say that the trees are wrong on what they have not seen: then nothing is certain
        self.slope, self.shift = (float(w[0]), float(w[1])) if w[0] > 0 else (1e-3, float(w[1]))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))

    def column(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))
