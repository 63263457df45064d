"""Gradient-boosted regression trees on squared error, with second-order gains and exact splits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Config:
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    random_state: int = 42
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0


def drawn(share: float, features: int) -> int:
    """Features that a tree sees."""
    return max(1, round(share * features))


def _shrunk(gradient, config: Config):
    """A sum of gradients after the L1 penalty's soft threshold."""
    return np.sign(gradient) * np.maximum(np.abs(gradient) - config.reg_alpha, 0.0)


def score(gradient, rows, config: Config):
    return _shrunk(gradient, config) ** 2 / (rows + config.reg_lambda)


def leaf(gradient: float, rows: int, config: Config) -> float:
    return float(-config.learning_rate * _shrunk(gradient, config) / (rows + config.reg_lambda)) if rows + config.reg_lambda > 0 else 0.0


@dataclass
class Booster:
    config: Config
    base: float
    trees: list = field(default_factory=list)
    gains: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                f = np.where(inner, feature[node], 0)
                go = x[np.arange(len(x)), f] < threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            out += value[node]
        return out

    def importance(self) -> np.ndarray:
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains


def _grow(x: np.ndarray, g: np.ndarray, config: Config, gains: np.ndarray, columns: np.ndarray):
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        total, n = g[rows].sum(), len(rows)
        value[node] = leaf(total, n, config)
        if depth == config.max_depth or n < 2 * config.min_child_weight:
            continue
        part = x[np.ix_(rows, columns)]
        order = np.argsort(part, axis=0, kind="stable")
        ordered = np.take_along_axis(part, order, axis=0)
        gl = np.cumsum(g[rows][order], axis=0)[:-1]
        nl = np.arange(1, n)[:, None]
        gain = score(gl, nl, config) + score(total - gl, n - nl, config) - score(total, n, config)
        ok = (ordered[1:] > ordered[:-1]) & (nl >= config.min_child_weight) & (n - nl >= config.min_child_weight)
        gain = np.where(ok, gain, -np.inf)
        at, f = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[at, f] > 2 * config.gamma + 1e-12:
            continue
        gains[columns[f]] += gain[at, f]
        cut = (ordered[at, f] + ordered[at + 1, f]) / 2
        goes = part[:, f] < cut
        if goes.all() or not goes.any():
            continue
        feature[node], threshold[node], left[node], right[node] = int(columns[f]), float(cut), len(feature), len(feature) + 1
        for child in (rows[goes], rows[~goes]):
            todo.append((len(feature), child, depth + 1))
            for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                a.append(v)
    return tuple(np.array(a) for a in (feature, threshold, left, right, value))


def fit(x: np.ndarray, y: np.ndarray, config: Config = Config()) -> Booster:
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if x.ndim != 2 or not len(x) or not np.isfinite(x).all() or not np.isfinite(y).all():
        raise ValueError("features and target must be finite and not empty")
    out = Booster(config, float(y.mean()), gains=np.zeros(x.shape[1]))
    at, rng = np.full(len(y), out.base), np.random.default_rng(config.random_state)
    for _ in range(config.n_estimators):
        columns = np.sort(rng.permutation(x.shape[1])[:drawn(config.colsample_bytree, x.shape[1])])
        part = rng.random(len(y)) < config.subsample
        rows = slice(None) if config.subsample >= 1 or not part.any() else part
        tree = _grow(x[rows], (at - y)[rows], config, out.gains, columns)
        out.trees.append(tree)
        one = Booster(config, 0.0, [tree])
        at += one.predict(x)
    return out
