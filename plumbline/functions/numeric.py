"""Numerical helpers for the driver and for vectorised kernels. Matrices have NaN where a value is missing."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability must lie between 0 and 1")
    return NormalDist().inv_cdf(p)


def gamma_tails(a: float, x: float) -> tuple[float, float]:
    """Lower and upper regularised incomplete gamma functions, by series below a + 1 and by continued fraction above."""
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        low = total * front
        return low, 1 - low
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        k = -i * (i - a)
        b += 2
        d = k * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + k / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    else:
        raise ArithmeticError(f"the gamma function of {a} and {x} doesn't converge")
    high = front * h
    return 1 - high, high


def chi_square_quantile(p: float, df: float) -> float:
    """Inverse of the chi-square distribution, by bracketed Newton steps on the smaller tail."""
    if not 0 < p < 1 or df <= 0:
        raise ValueError("need a probability between 0 and 1 and positive degrees of freedom")
    a = df / 2
    z = normal_quantile(p)
    x = max(df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3, 1e-300) / 2
    small = math.exp((math.log(p) + math.lgamma(a + 1)) / a)
    if p < 0.05 or x <= 1e-12:
        x = min(x, small) if x > 1e-12 else small
    low, high = 0.0, math.inf
    for _ in range(300):
        lower, upper = gamma_tails(a, x)
        gap = lower - p if p <= 0.5 else (1 - p) - upper
        low, high = (x, high) if gap < 0 else (low, x)
        density = math.exp((a - 1) * math.log(x) - x - math.lgamma(a))
        step = gap / density if density > 0 else math.inf
        new = x - step
        if not low < new < high:
            new = (low + high) / 2 if math.isfinite(high) else 2 * x
        if abs(new - x) <= 1e-15 * x:
            return 2 * new
        x = new
    return 2 * x


def row_correlations(a: np.ndarray, b: np.ndarray, zero_variance: float = 0.0) -> np.ndarray:
    """Pearson correlation of each row of a and b over the cells that both have; NaN for fewer than two."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    both = ~(np.isnan(a) | np.isnan(b))
    n = both.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = np.where(both, a, 0.0), np.where(both, b, 0.0)
        da = np.where(both, a - (a.sum(axis=1) / n)[:, None], 0.0)
        db = np.where(both, b - (b.sum(axis=1) / n)[:, None], 0.0)
        below = np.sqrt((da**2).sum(axis=1) * (db**2).sum(axis=1))
        out = np.clip((da * db).sum(axis=1) / below, -1, 1)
    out = np.where(below > 0, out, zero_variance)
    return np.where(n >= 2, out, np.nan)


def pseudo_inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse, or without the directions of negligible variance where the matrix is singular."""
    u, s, vt = np.linalg.svd(cov)
    if not s.size or s[0] == 0:
        return np.zeros_like(cov)
    eps = np.finfo(float).eps
    if s[-1] > 0 and s[0] / s[-1] < 1 / eps:
        return np.linalg.inv(cov)
    large = s > eps * len(cov) * s[0]
    return (vt[large].T / s[large]) @ u[:, large].T
