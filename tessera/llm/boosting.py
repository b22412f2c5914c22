"""Gradient-boosted trees: fitted in numpy on a small labelled sample, evaluated as a Spark SQL expression."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int = 8, penalty: float = 1.0):
    """A leaf value, or (feature, threshold, tree of x <= threshold, tree of the rest)."""
    total_g, total_h = g.sum(), h.sum()
    best = (1e-6, None, None)
    if depth and len(x) >= 2 * least:
        base = total_g**2 / (total_h + penalty)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if not len(at):
                continue
            gain = cg[at] ** 2 / (ch[at] + penalty) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + penalty) - base
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    _, f, cut = best
    if f is None:
        return float(-total_g / (total_h + penalty))
    left = x[:, f] <= cut
    return f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _value(low, x), _value(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3) -> list:
    """Trees for the log odds of y, without a constant term; leaves are already scaled."""
    trees, f = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = _scaled(_tree(x, p - y, p * (1 - p), depth), rate)
        f = f + _value(tree, x)
        trees.append(tree)
    return trees


def _scaled(tree, by: float):
    return (tree[0], tree[1], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else round(tree * by, 6)


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-sum((_value(t, x) for t in trees), np.zeros(len(x)))))


def calibrated(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of positives is at least ``precision``, half way to the next lower score; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)
    good = np.flatnonzero((share >= precision) & last)
    if not len(good):
        return 1.1
    k = int(good[-1])
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def as_sql(trees: list, features: list[str]) -> str:
    """The sum of the trees as an SQL expression over the features' expressions."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        f, cut, low, high = tree
        return f"if({features[f]} <= {cut!r}D, {one(low)}, {one(high)})"

    return f"({' + '.join(map(one, trees))})"
