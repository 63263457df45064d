"""GJR-GARCH(1,1,1) with constant mean and normal likelihood, by BFGS with the likelihood's own gradient from variance-targeting starts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

SCALE, LEAST_OBSERVATIONS = 100.0, 30
#: Where searches start: alpha, gamma, beta. The likelihood of a short window has several maxima, also on the bounds.
STARTS = ((0.05, 0.05, 0.85), (0.1, 0.1, 0.6), (0.01, 0.9, 0.05), (0.6, 0.02, 0.05), (0.02, 0.02, 0.02), (0.005, 0.005, 0.97))
#: A search ends when two steps in a row lower the negative log-likelihood by less. Values of a batch of windows that are worked on at once.
LEAST_GAIN, BATCH_VALUES = 1e-5, 1 << 16


@dataclass(frozen=True)
class Fit:
    """Parameters on the scale of the returns; variance is the in-sample series, forecast the next step's."""

    omega: float
    alpha: float
    gamma: float
    beta: float
    mu: float
    log_likelihood: float
    converged: bool
    variance: np.ndarray
    forecast_variance: float


def _variances(p: list[float], x: list[float], first: float) -> list[float]:
    """In-sample variances of x and the next step's."""
    mu, omega, alpha, gamma, beta = p
    v, out = first, [first]
    for r in x:
        e = r - mu
        v = omega + (alpha + gamma if e < 0 else alpha) * e * e + beta * v
        out.append(v)
    return out


def _unpack(q: np.ndarray, x_var: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unconstrained (.., 5) to mu, omega, alpha, gamma, beta: positive variance, persistence alpha + gamma / 2 + beta below 1."""
    z = np.exp(np.clip(q[..., 2:5], -30.0, 30.0))
    unit = 0.9995 / (1 + z.sum(axis=-1))
    return q[..., 0], np.exp(np.clip(q[..., 1], -40.0, 40.0)) * x_var, z[..., 0] * unit, 2 * z[..., 1] * unit, z[..., 2] * unit


def loss(q: np.ndarray, x: np.ndarray, held: np.ndarray, first: np.ndarray, x_var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihoods of many windows and their gradients in the unconstrained parameters.

    q has a row for each window, x and held a column: held says which rows of x are the window's. Only the recursions of the variance and of its derivatives by
    mu, omega, alpha, gamma and beta go row by row, for all windows at once.
    """
    mu, omega, alpha, gamma, beta = _unpack(q, x_var)
    e = x - mu
    square, fall = e * e, e < 0
    weight = alpha + gamma * fall
    v, drive, at = np.empty_like(x), omega + weight * square, first
    for t in range(len(x)):
        v[t] = at
        at = drive[t] + beta * at
    steps = np.stack([-2 * weight * e, np.ones_like(x), square, square * fall, v], axis=1)
    d, at = np.empty_like(steps), np.zeros(steps.shape[1:])
    for t in range(len(x)):
        d[t] = at
        at = steps[t] + beta * at
    s = np.maximum(v, 1e-12)
    total = 0.5 * (held.sum(axis=0) * math.log(2 * math.pi) + ((np.log(s) + square / s) * held).sum(axis=0))
    g = 0.5 * np.einsum("tm,tkm->mk", np.where(v > 1e-12, 1 / s - square / (s * s), 0.0) * held, d)
    g[:, 0] -= (e / s * held).sum(axis=0)
    # Back through _unpack: shares of alpha, gamma / 2 and beta of 0.9995.
    share = np.exp(np.clip(q[:, 2:5], -30, 30))
    share /= 1 + share.sum(axis=1, keepdims=True)
    by_share = 0.9995 * g[:, 2:5] * (1, 2, 1)
    inside = share * (by_share - (share * by_share).sum(axis=1, keepdims=True))
    return total, np.column_stack([g[:, 0], g[:, 1] * omega, inside])


def minimise(f, start: np.ndarray, *, rounds: int = 120, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BFGS with backtracking for many problems at once: f(points, which problems) gives values and gradients. (points, values, converged).

    A round tries one step of each problem that goes on; who accepts it takes a new direction, who doesn't shortens it.
    """
    x = np.array(start, dtype=float)
    m, k = x.shape
    value, g = f(x, np.arange(m))
    eye = np.eye(k)
    inverse = eye / np.maximum(1.0, np.abs(g).max(axis=1))[:, None, None]
    done, small, scale = np.abs(g).max(axis=1) < tol * (1 + np.abs(value)), np.zeros(m, dtype=int), np.ones(m)

    def direction(i: np.ndarray) -> np.ndarray:
        step = -np.einsum("mij,mj->mi", inverse[i], g[i])
        up = (step * g[i]).sum(axis=1) >= 0
        inverse[i[up]] = eye / np.maximum(1.0, np.abs(g[i[up]]).max(axis=1))[:, None, None]
        step[up] = -g[i[up]] / np.maximum(1.0, np.abs(g[i[up]]).max(axis=1))[:, None]
        return step * np.minimum(1.0, 3.0 / np.maximum(1e-12, np.abs(step).max(axis=1)))[:, None]

    step = direction(np.arange(m))
    for _ in range(rounds):
        i = np.flatnonzero(~done)
        if not len(i):
            break
        new = x[i] + scale[i, None] * step[i]
        value_new, g_new = f(new, i)
        slope = (step[i] * g[i]).sum(axis=1)
        good = value_new <= value[i] + 1e-4 * scale[i] * slope
        j = i[~good]  # the minimum of a parabola through what is known, within bounds
        over = value_new[~good] - value[j] - slope[~good] * scale[j]
        scale[j] *= np.clip(np.where(over > 0, -slope[~good] * scale[j] / np.where(over > 0, 2 * over, 1.0), 0.5), 0.1, 0.5)
        done[j[scale[j] < 1e-10]] = True
        j = i[good]
        s, y = new[good] - x[j], g_new[good] - g[j]
        gained, x[j], value[j], g[j], scale[j] = value[j] - value_new[good], new[good], value_new[good], g_new[good], 1.0
        sy = (s * y).sum(axis=1)
        ok = sy > 1e-12
        rho = 1 / np.where(ok, sy, 1.0)
        left = eye - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        made = left @ inverse[j] @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse[j[ok]] = made[ok]
        small[j] = np.where(gained < LEAST_GAIN, small[j] + 1, 0)
        done[j] = (np.abs(g[j]).max(axis=1) < tol * (1 + np.abs(value[j]))) | (small[j] == 2)
        step[j] = direction(j)
    return x, value, done & (np.abs(g).max(axis=1) < 1e-3 * (1 + np.abs(value)))


def _cold(mean: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, g, b in STARTS:
        left = 1 - a - g / 2 - b
        out.append(np.column_stack([mean, *(np.full(len(mean), math.log(z)) for z in (left, a / left, g / 2 / left, b / left))]))
    return out


def _batch(windows: list[np.ndarray]) -> list[Fit]:
    n, m = max(map(len, windows)), len(windows)
    x, held = np.zeros((n, m)), np.zeros((n, m))
    for k, w in enumerate(windows):
        x[:len(w), k], held[:len(w), k] = w * SCALE, 1.0
    first = np.array([np.var(w * SCALE) for w in windows])
    var = np.maximum(first, 1e-8)

    def search(starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own = np.tile(np.arange(m), len(starts))
        found = minimise(lambda q, i: loss(q, x[:, own[i]], held[:, own[i]], first[own[i]], var[own[i]]), np.concatenate(starts))
        return [tuple(part[at:at + m] for part in found) for at in range(0, len(own), m)]

    def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick = np.argmin([f[1] for f in found], axis=0)
        return tuple(np.array([f[k] for f in found])[pick, np.arange(m)] for k in range(3))

    alone = best(search(_cold(np.array([w.mean() * SCALE for w in windows]))))
    if m > 1:
        alone = best([alone, *search([np.roll(alone[0], 1, axis=0), np.roll(alone[0], -1, axis=0)])])
    out, s = [], SCALE * SCALE
    for k, w in enumerate(windows):
        p = [float(a) for a in _unpack(alone[0][k], var[k])]
        v = np.array(_variances(p, (w * SCALE).tolist(), float(first[k])))
        out.append(Fit(p[1] / s, p[2], p[3], p[4], p[0] / SCALE, -float(alone[1][k]), bool(alone[2][k]), v[:-1] / s, float(v[-1] / s)))
    return out


def fits(windows: list[np.ndarray]) -> list[Fit | None]:
    """Fits of windows that overlap their neighbours in the list; None for those with too few returns or any that isn't finite.

    Each is searched from all STARTS, then from what its two neighbours found. Windows are worked on in batches, as many as their values allow.
    """
    arrays = [np.asarray(w, dtype=float) for w in windows]
    usable = [k for k, w in enumerate(arrays) if len(w) >= LEAST_OBSERVATIONS and np.isfinite(w).all()]
    out: list[Fit | None] = [None] * len(arrays)
    size = max(1, BATCH_VALUES // max((len(arrays[k]) for k in usable), default=1))
    for at in range(0, len(usable), size):
        part = usable[at:at + size]
        for k, found in zip(part, _batch([arrays[k] for k in part]), strict=True):
            out[k] = found
    return out


def fit(returns: np.ndarray) -> Fit:
    found = fits([returns])[0]
    if found is None:
        raise ValueError(f"at least {LEAST_OBSERVATIONS} finite returns are needed")
    return found
