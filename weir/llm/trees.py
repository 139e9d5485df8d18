"""Small boosted trees and random forests, fitted on the driver and scored as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf's value, or (feature, threshold, tree at or under it, tree above it).
Tree = float | tuple


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, pick: Callable[[], np.ndarray], lam: float) -> Tree:
    """A regression tree on gradients g and weights h (Newton steps)."""
    leaf = float(g.sum() / (h.sum() + lam))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    base = g.sum() ** 2 / (h.sum() + lam)
    best = (1e-9, None, None)
    for f in pick():
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        cuts = (values[1:] + values[:-1]) / 2
        if len(cuts) > 24:
            cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 24)))
        under = x[:, f][:, None] <= cuts
        n, gl, hl = under.sum(0), g @ under, h @ under
        gain = gl**2 / (hl + lam) + (g.sum() - gl) ** 2 / (h.sum() - hl + lam) - base
        gain[(n < least) | (len(x) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float(cuts[k]))
    if best[1] is None:
        return leaf
    side = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[side], g[side], h[side], depth - 1, least, pick, lam), _grow(x[~side], g[~side], h[~side], depth - 1, least, pick, lam))


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, predict(a, x), predict(b, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """Gradient boosting of the log loss: (bias, trees); the score is their sum."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, trees = float(np.log(p / (1 - p))), []
    score = np.full(len(y), bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - q, q * (1 - q), depth, 4, lambda: np.arange(x.shape[1]), 1.0)
        tree = _scaled(tree, rate)
        trees.append(tree)
        score += predict(tree, x)
    return bias, trees


def _scaled(tree: Tree, by: float) -> Tree:
    return tree * by if isinstance(tree, float) else (tree[0], tree[1], _scaled(tree[2], by), _scaled(tree[3], by))


def forest(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 5, seed: int = 5) -> list[Tree]:
    """A random forest: each tree on a bootstrap sample, a random share of features at each node; the score is the mean."""
    rng = np.random.default_rng(seed)
    k = max(1, int(round(x.shape[1] ** 0.5)) + 1)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(x), len(x))
        out.append(_grow(x[own], y[own].astype(float), np.ones(len(own)), depth, 2, lambda: rng.permutation(x.shape[1])[:k], 1e-9))
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b): sigmoid(a * score + b) is calibrated on these held-out scores."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        m = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(m, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return a, b


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the held-out precision holds; 0.5 at least."""
    for t in np.linspace(0.5, 0.99, 50):
        if (p >= t).any() and y[p >= t].mean() >= precision:
            return float(t)
    return 0.99


def column(tree: Tree, feature: Callable[[int], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(round(tree, 6))
    f, t, a, b = tree
    return F.when(feature(f) <= F.lit(t), column(a, feature)).otherwise(column(b, feature))


def total(trees: list[Tree], feature: Callable[[int], Column]) -> Column:
    return reduce(lambda a, b: a + b, (column(t, feature) for t in trees))
