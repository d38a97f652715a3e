"""Gradient-boosted trees for small bounded samples, fitted on the driver and applied as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a number; a split is (feature, bound, tree up to the bound, tree beyond it).
Tree = float | tuple


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8) -> tuple[float, list[Tree]]:
    """Log-odds before any tree, and the trees, for labels 0 and 1 under logistic loss."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate, least)
        made.append(tree)
        score = score + apply_tree(tree, x)
    return start, made


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, rate: float, least: int) -> Tree:
    total, weight = slope[rows].sum(), curve[rows].sum() + 1.0
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            for bound in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= bound
                if least <= low.sum() <= len(rows) - least:
                    a, wa = slope[rows][low].sum(), curve[rows][low].sum() + 1.0
                    b, wb = total - a, weight - wa + 1.0
                    gain = a * a / wa + b * b / wb - total * total / weight
                    if gain > best[0]:
                        best = (gain, f, float(bound))
    if best[1] is None:
        return float(rate * total / weight)
    low = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, slope, curve, rows[low], depth - 1, rate, least), _grow(x, slope, curve, rows[~low], depth - 1, rate, least))


def apply_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, apply_tree(low, x), apply_tree(high, x))


def tree_column(tree: Tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, bound, low, high = tree
    return F.when(features[f] <= bound, tree_column(low, features)).otherwise(tree_column(high, features))


def calibrated(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that turn scores into log-odds (Platt scaling by Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        g = np.array([((y - p) * score).sum() - 1e-3 * (a - 1), (y - p).sum() - 1e-3 * b])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return a, b


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability at and above which ``precision`` of the rows are positive; 1.01 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.flatnonzero(np.concatenate([p[order][1:] != p[order][:-1], [True]]))
    good = ends[right[ends] >= precision]
    return float(p[order][good[-1]]) if len(good) else 1.01
