"""Lag-weighted ridge vector autoregressions, iterated and direct.

For equation j the coefficients minimise |Y_j - X b|^2 + lam * sum_k d_jk b_k^2
with d = 0 for the intercept, l^alpha for own lags and kappa * l^alpha for
cross lags. X holds the intercept, then all variables at lag 1, then at lag 2
and so on. lam = 0 is least squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    coefficients: np.ndarray  # (1 + n p, n)
    sigma: np.ndarray
    rank: int
    condition: float
    modulus: float  # of the largest companion root
    n_obs: int
    p: int

    @property
    def stable(self) -> bool:
        return self.modulus < 1


def design(y: np.ndarray, p: int, lead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(X, Y): rows of lags up to t, targets at t + lead."""
    steps, n = y.shape
    rows = steps - p - lead + 1
    if rows <= 0:
        return np.zeros((0, 1 + n * p)), np.zeros((0, n))
    lags = np.lib.stride_tricks.sliding_window_view(y, p, axis=0)[:rows]  # (rows, n, p), oldest first
    x = lags[:, :, ::-1].transpose(0, 2, 1).reshape(rows, n * p)
    return np.column_stack((np.ones(rows), x)), y[p + lead - 1 : p + lead - 1 + rows]


def penalties(n: int, p: int, alpha: float, kappa: float) -> np.ndarray:
    """(1 + n p, n): the penalty of each coefficient in each equation."""
    lag = np.repeat(np.arange(1, p + 1, dtype=float) ** alpha, n)[:, None]
    own = np.tile(np.eye(n, dtype=bool), (p, 1))
    return np.vstack((np.zeros((1, n)), np.where(own, lag, kappa * lag)))


def solve(x: np.ndarray, y: np.ndarray, lam: float, d: np.ndarray) -> np.ndarray:
    if lam == 0:
        return np.linalg.lstsq(x, y, rcond=None)[0]
    if (d == d[:, :1]).all():  # one penalty for all equations: one factorisation
        root = np.diag(np.sqrt(lam * d[:, 0]))
        return np.linalg.lstsq(np.vstack((x, root)), np.vstack((y, np.zeros((len(root), y.shape[1])))), rcond=None)[0]
    zero = np.zeros(len(d))
    return np.column_stack([np.linalg.lstsq(np.vstack((x, np.diag(np.sqrt(lam * d[:, j])))), np.r_[y[:, j], zero], rcond=None)[0] for j in range(y.shape[1])])


def fit(y: np.ndarray, p: int, lam: float, alpha: float = 0.0, kappa: float = 1.0, lead: int = 1) -> Fit:
    x, target = design(y, p, lead)
    if len(x) < 2:
        raise ValueError("too few observations")
    n = y.shape[1]
    b = solve(x, target, lam, penalties(n, p, alpha, kappa))
    e = target - x @ b
    free = len(x) - x.shape[1]
    companion = np.zeros((n * p, n * p))
    companion[:n] = b[1:].T
    companion[n:, :-n] = np.eye(n * (p - 1))
    return Fit(b, e.T @ e / (free if free > 0 else len(x)), int(np.linalg.matrix_rank(x)), float(np.linalg.cond(x)), float(np.abs(np.linalg.eigvals(companion)).max()), len(x), p)


def iterate(f: Fit, history: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts for 1 ... horizon steps."""
    past = list(history[-f.p :])
    out = []
    for _ in range(horizon):
        x = np.concatenate(([1.0], *past[: -f.p - 1 : -1]))
        out.append(x @ f.coefficients)
        past.append(out[-1])
    return np.array(out)


def direct(y: np.ndarray, p: int, lam: float, alpha: float, kappa: float, horizon: int) -> np.ndarray:
    """Forecast for ``horizon`` steps by a regression on that lead."""
    f = fit(y, p, lam, alpha, kappa, horizon)
    return np.concatenate(([1.0], *y[: -p - 1 : -1])) @ f.coefficients


def standardised(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, deviation = y.mean(axis=0), np.maximum(y.std(axis=0, ddof=1), 1e-8)
    return (y - mean) / deviation, mean, deviation


def forecast(y: np.ndarray, p: int, lam: float, alpha: float, kappa: float, horizons: list[int], method: str = "iterated") -> np.ndarray | None:
    """(horizons, n) on the original scale; None where the fit isn't possible or not finite."""
    try:
        z, mean, deviation = standardised(y)
        if method == "iterated":
            got = iterate(fit(z, p, lam, alpha, kappa), z, max(horizons))[[h - 1 for h in horizons]]
        else:
            got = np.array([direct(z, p, lam, alpha, kappa, h) for h in horizons])
    except (ValueError, np.linalg.LinAlgError):
        return None
    got = got * deviation + mean
    return got if np.isfinite(got).all() else None


def information_criteria(y: np.ndarray, p: int) -> tuple[float, float]:
    """(AIC, BIC) of a least-squares VAR."""
    x, target = design(y, p)
    e = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
    sign, logdet = np.linalg.slogdet(e.T @ e / len(x))
    if sign <= 0:
        return np.inf, np.inf
    k = p * y.shape[1] ** 2
    return logdet + 2 * k / len(x), logdet + np.log(len(x)) * k / len(x)


MAX_LAG = 4  # of the benchmarks


def criterion_lag(y: np.ndarray, which: int, max_lag: int) -> int:
    """The lag of least criterion (0: AIC, 1: BIC) among those that leave observations to fit on, the shorter on ties; 1 if none does."""
    usable = [p for p in range(1, max_lag + 1) if len(y) - p > 1 + p * y.shape[1]] or [1]
    return min(usable, key=lambda p: (information_criteria(y, p)[which], p))


def benchmark(y: np.ndarray, kind: str, horizons: list[int], max_lag: int = MAX_LAG) -> tuple[np.ndarray | None, list[int]]:
    """no_change, var_aic, var_bic or ar_univariate; (forecasts, chosen lag of each variable)."""
    n = y.shape[1]
    if kind == "no_change":
        return np.repeat(y[-1:], len(horizons), axis=0), [0] * n
    if kind == "ar_univariate":
        lags = [criterion_lag(y[:, j : j + 1], 0, max_lag) for j in range(n)]
        parts = [forecast(y[:, j : j + 1], lag, 0.0, 0.0, 1.0, horizons) for j, lag in enumerate(lags)]
        return (None if any(p is None for p in parts) else np.hstack(parts)), lags
    if kind not in ("var_aic", "var_bic"):
        raise ValueError(f"no benchmark {kind}")
    lag = criterion_lag(y, 0 if kind == "var_aic" else 1, max_lag)
    return forecast(y, lag, 0.0, 0.0, 1.0, horizons), [lag] * n
