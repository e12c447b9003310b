"""Bayesian VAR with a conjugate Minnesota prior and unit-root dummy observations.

Follows the published hierarchical-prior treatment: shrinkage lam, single unit
root theta, sum of coefficients mu, residual scales psi. Sigma is inverse
Wishart (psi, n + 2); coefficients given Sigma are normal around own first lags
of 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .ridge import design

BOUNDS = {"lam": (1e-4, 5.0), "theta": (1e-4, 50.0), "mu": (1e-4, 50.0)}
GAMMA = {"lam": (0.2, 0.4), "theta": (1.0, 1.0), "mu": (1.0, 1.0)}  # mode and deviation of the hyperpriors


@dataclass
class Context:
    y: np.ndarray
    x: np.ndarray
    target: np.ndarray
    p: int
    scale: np.ndarray  # AR(1) residual variances
    start: np.ndarray  # mean of the first p rows


def context(y: np.ndarray, p: int = 5) -> Context:
    x, target = design(y, p)
    scale = []
    for j in range(y.shape[1]):
        a, b = np.column_stack((np.ones(len(y) - 1), y[:-1, j])), y[1:, j]
        e = b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
        scale.append(max(float(e @ e / max(1, len(b) - 2)), 1e-12))
    return Context(y, x, target, p, np.array(scale), y[:p].mean(axis=0))


def dummies(c: Context, theta: float, mu: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(c.start)
    sums = np.diag(c.start / mu)
    x = np.vstack((np.column_stack((np.zeros(n), np.tile(sums, (1, c.p)))), np.r_[1 / theta, np.tile(c.start / theta, c.p)]))
    return x, np.vstack((sums, c.start / theta))


def prior(c: Context, lam: float, psi: np.ndarray, constant: float = 1e7) -> tuple[np.ndarray, np.ndarray]:
    n = len(psi)
    b = np.zeros((1 + n * c.p, n))
    b[1 : n + 1] = np.eye(n)
    lag = np.repeat(np.arange(1, c.p + 1, dtype=float), n)
    return b, np.r_[constant, lam**2 / lag**2 / np.tile(psi, c.p)]


def log_evidence(x: np.ndarray, y: np.ndarray, b: np.ndarray, omega: np.ndarray, psi: np.ndarray) -> float:
    """ln p(Y | X) of the conjugate model, in closed form."""
    steps, n = y.shape
    d = n + 2
    post = x.T @ x + np.diag(1 / omega)
    beta = np.linalg.solve(post, x.T @ y + b / omega[:, None])
    e, shift = y - x @ beta, beta - b
    s = e.T @ e + shift.T @ (shift / omega[:, None])
    root, inverse = np.sqrt(omega), 1 / np.sqrt(psi)
    first = np.linalg.slogdet(np.eye(len(omega)) + root[:, None] * (x.T @ x) * root)[1]
    second = np.linalg.slogdet(np.eye(n) + inverse[:, None] * s * inverse)[1]
    gammas = sum(math.lgamma((steps + d - i) / 2) - math.lgamma((d - i) / 2) for i in range(n))
    return -n * steps / 2 * math.log(math.pi) + gammas - steps / 2 * np.log(psi).sum() - n / 2 * first - (steps + d) / 2 * second


def log_gamma_prior(value: float, mode: float, deviation: float) -> float:
    shape = (2 + (mode / deviation) ** 2 + math.sqrt((4 + (mode / deviation) ** 2) * (mode / deviation) ** 2)) / 2
    scale = deviation / math.sqrt(shape)
    return (shape - 1) * math.log(value) - value / scale - shape * math.log(scale) - math.lgamma(shape)


def log_posterior(c: Context, v: np.ndarray) -> float:
    """v: lam, theta, mu and, if longer, the residual scales. -inf outside the bounds."""
    lam, theta, mu = v[:3]
    psi = v[3:] if len(v) > 3 else c.scale
    inside = all(BOUNDS[k][0] < a < BOUNDS[k][1] for k, a in zip(BOUNDS, (lam, theta, mu))) and (psi > c.scale / 101).all() and (psi < c.scale * 101).all()
    if not inside:
        return -np.inf
    b, omega = prior(c, lam, psi)
    dx, dy = dummies(c, theta, mu)
    evidence = log_evidence(np.vstack((dx, c.x)), np.vstack((dy, c.target)), b, omega, psi) - log_evidence(dx, dy, b, omega, psi)
    return evidence + sum(log_gamma_prior(a, *GAMMA[k]) for k, a in zip(GAMMA, (lam, theta, mu)))


def simplex(f, start: np.ndarray, step: float = 0.3, rounds: int = 400, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Downhill simplex search for a minimum."""
    n = len(start)
    points = np.vstack((start, start + step * np.eye(n)))
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if np.abs(values[-1] - values[0]) < tolerance:
            break
        centre, worst = points[:-1].mean(axis=0), points[-1]
        for reach in (1.0, 2.0, 0.5, -0.5):
            trial = centre + reach * (centre - worst)
            got = f(trial)
            if reach == 1.0:
                mirrored, at = trial, got
                if values[0] <= got < values[-2]:
                    points[-1], values[-1] = trial, got
                    break
                if got >= values[-2]:
                    continue
            elif reach == 2.0:
                if at < values[0]:
                    points[-1], values[-1] = (trial, got) if got < at else (mirrored, at)
                    break
            elif got < min(at if reach == 0.5 else np.inf, values[-1]):
                points[-1], values[-1] = trial, got
                break
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            values[1:] = [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], float(values[k])


def mode(c: Context) -> np.ndarray:
    """Hyperparameters (lam, theta, mu) of greatest posterior, searched on the logit scale of their boxes."""
    low, high = np.array(list(BOUNDS.values())).T
    box = lambda t: low + (high - low) / (1 + np.exp(-np.clip(t, -30, 30)))
    start = np.array([0.2, 1.0, 1.0])
    found, _ = simplex(lambda t: -log_posterior(c, box(t)) if np.isfinite(log_posterior(c, box(t))) else 1e10, -np.log((high - start) / (start - low)))
    return box(found)


def hessian(f, at: np.ndarray, step: float = 1e-3) -> np.ndarray:
    n = len(at)
    h = step * np.maximum(np.abs(at), 0.1)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            ei, ej = np.eye(n)[i] * h[i], np.eye(n)[j] * h[j]
            out[i, j] = out[j, i] = (f(at + ei + ej) - f(at + ei - ej) - f(at - ei + ej) + f(at - ei - ej)) / (4 * h[i] * h[j])
    return out


def metropolis(c: Context, at: np.ndarray, draws: int, discard: int, rng: np.random.Generator, pace: float = 1.0) -> tuple[np.ndarray, float]:
    """Random-walk draws of (lam, theta, mu) and the acceptance rate; the proposal is the inverse Hessian, made positive definite."""
    values, vectors = np.linalg.eigh(hessian(lambda v: -log_posterior(c, v) if np.isfinite(log_posterior(c, v)) else 1e10, at))
    root = vectors * np.sqrt(pace**2 / np.maximum(np.abs(values), 1e-3))
    now, level, kept, accepted = at, log_posterior(c, at), [], 0
    for k in range(draws + discard):
        trial = now + root @ rng.standard_normal(len(at))
        got = log_posterior(c, trial)
        if np.log(rng.random()) < got - level:
            now, level, accepted = trial, got, accepted + 1
        if k >= discard:
            kept.append(now)
    return np.array(kept), accepted / max(1, draws + discard)


def posterior(c: Context, v: np.ndarray):
    """(mean, covariance factor of coefficients, scale matrix, degrees) given hyperparameters."""
    psi = v[3:] if len(v) > 3 else c.scale
    b, omega = prior(c, v[0], psi)
    dx, dy = dummies(c, v[1], v[2])
    x, y = np.vstack((dx, c.x)), np.vstack((dy, c.target))
    post = x.T @ x + np.diag(1 / omega)
    beta = np.linalg.solve(post, x.T @ y + b / omega[:, None])
    e, shift = y - x @ beta, beta - b
    return beta, np.linalg.cholesky(np.linalg.inv(post)), np.diag(psi) + e.T @ e + shift.T @ (shift / omega[:, None]), len(y) + len(psi) + 2


def predictive(c: Context, v: np.ndarray, horizon: int, rng: np.random.Generator | None) -> np.ndarray:
    """(horizon, n): one simulated path, or the path of the posterior mean without a generator."""
    beta, root, scale, degrees = posterior(c, v)
    n = len(c.start)
    shock = np.zeros((n, n))
    if rng is not None:
        w = rng.standard_normal((degrees, n)) @ np.linalg.cholesky(np.linalg.inv(scale)).T
        shock = np.linalg.cholesky(np.linalg.inv(w.T @ w))
        beta = beta + root @ rng.standard_normal(beta.shape) @ shock.T
    past, out = list(c.y[-c.p :]), []
    for _ in range(horizon):
        step = np.concatenate(([1.0], *past[: -c.p - 1 : -1])) @ beta
        step = step + (shock @ rng.standard_normal(n) if rng is not None else 0)
        past.append(step)
        out.append(step)
    return np.array(out)


def search(score, candidates: list[tuple], penalty: float = 1e10) -> tuple[tuple, float]:
    """The candidate of least finite score, the first on ties; an error if none is finite."""
    values = [s if np.isfinite(s := score(c)) else penalty for c in candidates]
    k = int(np.argmin(values))
    if values[k] >= penalty:
        raise ValueError("no candidate has a finite score")
    return candidates[k], values[k]


def forecast(y: np.ndarray, p: int, lam: float, theta: float, mu: float, horizons: list[int]) -> np.ndarray | None:
    """(horizons, n) posterior-mean forecasts at given hyperparameters, without shocks; None where they can't be had."""
    try:
        if len(y) < 2 * p + 2:
            return None
        got = predictive(context(y, p), np.array([lam, theta, mu]), max(horizons), None)[[h - 1 for h in horizons]]
    except (ValueError, ArithmeticError, np.linalg.LinAlgError):
        return None
    return got if np.isfinite(got).all() else None
