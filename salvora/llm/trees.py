"""Histogram decision trees: gradient boosting, random forests and isotonic calibration, for samples that fit one machine."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner bin edges of each column, at quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]


@dataclass
class Tree:
    """Nodes in arrays: rows with x[feature] > threshold go right; a feature below 0 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, np.where(go, self.right[at], self.left[at]), at)


def grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float, damp: float, rng: np.random.Generator | None = None, tries: int | None = None) -> Tree:
    """A tree that fits -grad / hess by leaves; tries: features drawn for each node."""
    nodes: list[list] = []

    def build(rows: np.ndarray, left_depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -g / (h + damp)])
        if left_depth == 0 or h < 2 * least:
            return at
        best = (1e-9, -1, -1)
        columns = range(x.shape[1]) if rng is None else rng.choice(x.shape[1], tries, replace=False)
        for f in columns:
            size = len(edges[f]) + 1
            if size < 2:
                continue
            bg = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1]
            bh = np.cumsum(np.bincount(binned[rows, f], hess[rows], size))[:-1]
            gain = bg**2 / (bh + damp) + (g - bg) ** 2 / (h - bh + damp) - g**2 / (h + damp)
            gain[(bh < least) | (h - bh < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
        if best[1] < 0:
            return at
        _, f, k = best
        right = binned[rows, f] > k
        nodes[at][0], nodes[at][1] = f, float(edges[f][k])
        nodes[at][2] = build(rows[~right], left_depth - 1)
        nodes[at][3] = build(rows[right], left_depth - 1)
        return at

    build(np.arange(len(x)), depth)
    cols = list(zip(*nodes))
    return Tree(np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float))


def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    # a value equal to an edge stays on its left, as in Tree.predict
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1) if len(x) else np.zeros((0, x.shape[1]), int)


@dataclass
class Boosted:
    """Gradient-boosted trees for a 0/1 label, by log loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if len(np.unique(y)) < 2:
            return self
        edges = edges_of(x)
        binned, margin = _bin(x, edges), np.full(len(x), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = grow(x, edges, binned, q - y, np.maximum(q * (1 - q), 1e-6), self.depth, 0.5, 1.0)
            self.trees.append(tree)
            margin = margin + self.rate * tree.predict(x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out


@dataclass
class Forest:
    """Random forest for a 0/1 label: bootstrapped trees over drawn features, averaged."""

    size: int = 40
    depth: int = 8
    seed: int = 7
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        edges = edges_of(x)
        binned = _bin(x, edges)
        tries = max(1, int(np.sqrt(x.shape[1]) + 1))
        self.trees = []
        for _ in range(self.size):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(grow(x[rows], edges, binned[rows], -y[rows].astype(float), np.ones(len(x)), self.depth, 2.0, 1e-9, rng, tries))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.empty(0)


@dataclass
class Isotonic:
    """Non-decreasing steps by pooling adjacent violators, linear between them."""

    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    value: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, first, last
        for s, v in zip(score[order], y[order].astype(float)):
            if blocks and blocks[-1][3] == s:  # ties share a value
                m, w, a, b = blocks.pop()
                blocks.append([(m * w + v) / (w + 1), w + 1, a, b])
            else:
                blocks.append([v, 1, s, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, _, b2 = blocks.pop()
                m1, w1, a1, _ = blocks.pop()
                blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, a1, b2])
        self.at = np.array([x for b in blocks for x in (b[2], b[3])])
        self.value = np.array([b[0] for b in blocks for _ in (0, 1)])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
