"""Gaussian hidden Markov model: Baum-Welch and forward filtering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Config:
    n_components: int = 3
    covariance_type: str = "full"
    n_iter: int = 300
    tol: float = 1e-4
    random_state: int = 42
    min_covar: float = 1e-6


@dataclass
class Model:
    config: Config
    mean: np.ndarray
    scale: np.ndarray
    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = float("nan")
    iterations: int = 0
    converged: bool = False
    last: np.ndarray | None = None

    def log_density(self, z: np.ndarray) -> np.ndarray:
        k, d = self.means.shape
        out = np.empty((len(z), k))
        for s in range(k):
            cov = self.covariances[s] + 1e-12 * np.eye(d)
            chol = np.linalg.cholesky(cov)
            y = np.linalg.solve(chol, (z - self.means[s]).T)
            out[:, s] = -0.5 * (y * y).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, dtype=float) - self.mean) / self.scale

    def filter(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Filtered state probabilities; ``start`` is a state before the first row, which is propagated first."""
        density = self.log_density(self.scaled(x))
        p = self.start if start is None else start @ self.transition
        out = np.empty_like(density)
        for t, row in enumerate(density):
            if t:
                p = out[t - 1] @ self.transition
            w = p * _relative(row)
            out[t] = w / w.sum()
        return out

    def product(self, x: np.ndarray) -> np.ndarray:
        """The matrix that takes a state's weights, propagated to the first row, to the weights after the last one, up to its scale.

        Matrices of neighbours are multiplied in pairs, all pairs at once, and scaled to their largest entry.
        """
        steps = self.transition * _relative(self.log_density(self.scaled(x)))[:, None, :]
        steps[0] = np.diag(_relative(self.log_density(self.scaled(x[:1])))[0])
        while len(steps) > 1:
            odd = steps[-1:] if len(steps) % 2 else steps[:0]
            steps = np.concatenate([steps[0:len(steps) - len(odd):2] @ steps[1::2], odd])
            steps /= np.maximum(steps.max(axis=(1, 2), keepdims=True), 1e-300)
        return steps[0]

    def filter_after_training(self, x: np.ndarray) -> np.ndarray:
        return self.filter(x, self.last)


def _relative(density: np.ndarray) -> np.ndarray:
    """Densities against the largest of each row, no smaller than exp(-300), so that a row far from its likely states keeps a weight."""
    return np.exp(np.maximum(density - density.max(axis=-1, keepdims=True), -300.0))


def _floor(cov: np.ndarray, least: float) -> np.ndarray:
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T


def _start(z: np.ndarray, config: Config, rng: np.random.Generator) -> np.ndarray:
    """Centres by a few rounds of k-means from spread-out rows."""
    centres = [z[rng.integers(len(z))]]
    for _ in range(config.n_components - 1):
        d = np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))])
    c = np.array(centres)
    for _ in range(10):
        own = ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([z[own == s].mean(axis=0) if (own == s).any() else c[s] for s in range(len(c))])
    return c


def fit(observations: np.ndarray, config: Config = Config()) -> Model:
    x = np.asarray(observations, dtype=float)
    k = config.n_components
    if x.ndim != 2 or len(x) < 2 * k or not np.isfinite(x).all():
        raise ValueError("observations must be finite and more than twice the states")
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z, rng = (x - mean) / scale, np.random.default_rng(config.random_state)
    d = z.shape[1]
    whole = _floor(np.cov(z.T).reshape(d, d), config.min_covar)
    m = Model(config, mean, scale, np.full(k, 1 / k), np.full((k, k), 1 / k), _start(z, config, rng), np.repeat(whole[None], k, axis=0))
    before = -np.inf
    for m.iterations in range(1, config.n_iter + 1):
        density = m.log_density(z)
        shift = density.max(axis=1)
        b = _relative(density)
        n = len(z)
        alpha, c = np.empty((n, k)), np.empty(n)
        p = m.start * b[0]
        for t in range(n):
            if t:
                p = (alpha[t - 1] @ m.transition) * b[t]
            c[t] = max(p.sum(), 1e-300)
            alpha[t] = p / c[t]
        beta = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            beta[t] = m.transition @ (b[t + 1] * beta[t + 1]) / c[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        xi = m.transition * (alpha[:-1].T @ (b[1:] * beta[1:] / c[1:, None]))
        m.log_likelihood = float(np.log(c).sum() + shift.sum())
        m.converged = m.log_likelihood - before < config.tol
        if m.converged:
            break
        before = m.log_likelihood
        m.start = gamma[0]
        left = xi.sum(axis=1, keepdims=True)
        m.transition = np.where(left > 0, xi / np.maximum(left, 1e-300), m.transition)  # a state that only the last row is in has no transitions
        weight = np.maximum(gamma.sum(axis=0), 1e-10)
        m.means = gamma.T @ z / weight[:, None]
        for s in range(k):
            e = z - m.means[s]
            cov = (gamma[:, s, None] * e).T @ e / weight[s]
            m.covariances[s] = _floor(np.diag(np.diag(cov)) if config.covariance_type == "diag" else cov, config.min_covar)
    m.last = m.filter(x)[-1]
    return m
