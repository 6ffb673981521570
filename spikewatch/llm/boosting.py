"""Gradient-boosted trees over a small table of counted, binned feature rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Node:
    total_g, total_h = g.sum(), h.sum()
    node = Node(value=float(rate * total_g / (total_h + ridge)))
    if depth == 0 or len(x) < 2:
        return node
    best, base = 1e-6, total_g ** 2 / (total_h + ridge)
    for f in range(x.shape[1]):
        top = int(x[:, f].max())
        gs, hs = np.cumsum(np.bincount(x[:, f], g, top + 1))[:-1], np.cumsum(np.bincount(x[:, f], h, top + 1))[:-1]
        if not len(gs):
            continue
        gain = gs ** 2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - base
        gain[(hs <= 0) | (hs >= total_h)] = 0
        if gain.max() > best:
            best, node.feature, node.cut = float(gain.max()), f, int(gain.argmax())
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.left = _grow(x[low], g[low], h[low], depth - 1, rate, ridge)
        node.right = _grow(x[~low], g[~low], h[~low], depth - 1, rate, ridge)
    return node


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    return np.where(low, _values(node.left, x), _values(node.right, x))


@dataclass
class Boosted:
    """Log-odds: ``start`` plus the trees' values."""
    start: float
    trees: list[Node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The margin as a SQL expression over binned feature columns."""

        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.cut, of(node.left)).otherwise(of(node.right))

        out = F.lit(self.start)
        for tree in self.trees:
            out = out + of(tree)
        return out


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, *, rounds: int = 30, depth: int = 3,
          rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the log loss; row ``i`` stands for ``total[i]`` cases,
    ``positive[i]`` of them positive."""
    n, p = total.sum(), positive.sum()
    model = Boosted(float(np.log((p + 0.5) / (n - p + 0.5))), [])
    margin = np.full(len(x), model.start)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        tree = _grow(x, positive - total * prob, total * prob * (1 - prob), depth, rate, ridge)
        if tree.feature < 0:
            break
        model.trees.append(tree)
        margin = margin + _values(tree, x)
    return model
