"""Student's t tail probabilities, vectorised, without scipy."""

from __future__ import annotations

import math

import numpy as np

ROUNDS = 200_000  # of the continued fraction; it needs about the root of the larger parameter


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def log_gamma_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln Gamma(a + b) - ln Gamma(a), by Stirling's series where a is large and the plain difference would cancel."""
    large = np.maximum(a, 1e3)
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    far = (large - 0.5) * np.log1p(b / large) + b * np.log(large + b) - b + series(large + b) - series(large)
    return np.where(a >= 1e3, far, log_gamma(a + b) - log_gamma(a))


def beta_tails(a, b, x, rest) -> tuple[np.ndarray, np.ndarray]:
    """Regularised I_x(a, b) and 1 - I_x(a, b), each without cancellation; ``rest`` is 1 - x.

    By the continued fraction on the side of the mean where it converges fast;
    it runs until every value has settled, whatever the parameters.
    """
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, rest, x), np.where(flip, x, rest)
    inside = (y > 0) & (z > 0)
    y, z = np.where(inside, y, 0.5), np.where(inside, z, 0.5)
    log = lambda v, other: np.where(v > 0.5, np.log1p(-np.minimum(other, 0.5)), np.log(v))
    small, big = np.minimum(p, q), np.maximum(p, q)
    front = np.exp(p * log(y, z) + q * log(z, y) + log_gamma_ratio(big, small) - log_gamma(small)) / p

    def away(v):  # a denominator of zero would end the recurrence
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c = np.ones_like(y)
    d = total = 1 / away(1 - (p + q) * y / (p + 1))
    settled = ~inside
    for m in range(1, ROUNDS):
        step = np.ones_like(y)
        for numerator in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / away(1 + numerator * d)
            c = away(1 + numerator / c)
            step = step * c * d
        total = np.where(settled, total, total * step)
        settled = settled | (np.abs(step - 1) <= 1e-13)
        if settled.all():
            break
    else:
        raise ArithmeticError("the incomplete beta function did not settle")
    value = np.clip(np.where(inside, front * total, 0.0), 0, 1)
    return np.where(flip, 1 - value, value), np.where(flip, value, 1 - value)


def t_two_sided(t, degrees) -> np.ndarray:
    """P(|T| > |t|)."""
    t, degrees = np.asarray(t, float), np.asarray(degrees, float)
    square = np.minimum(np.abs(t), 1e150) ** 2
    return beta_tails(0.5, degrees / 2, square / (degrees + square), degrees / (degrees + square))[1]
