"""Distribution functions and small linear algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised; continued fraction by Lentz's method."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower; series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def f_p(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else float("nan")


def chi2_p(x: float, df: float) -> float:
    return 1 - incomplete_gamma(df / 2, x / 2) if df > 0 else float("nan")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def format_number(x: Column) -> Column:
    """Scientific below 1e-4, two places from 1000, else four."""
    size = F.abs(x)
    return (
        F.when(x.isNull(), "")
        .when((size > 0) & (size < 1e-4), F.format_string("%.2e", x))
        .when(size >= 1000, F.format_string("%.2f", x))
        .otherwise(F.format_string("%.4f", x))
    )


def percent_effect(beta: Column, log_outcome: bool) -> Column:
    """Effect in percent of a log outcome; the coefficient itself otherwise."""
    return F.expm1(beta) * 100 if log_outcome else beta


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares solution by the pseudo-inverse of the scaled matrix, so that collinear columns do no harm."""
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (b / scale) / scale


def inverse(a: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-11, hermitian=True) / np.outer(scale, scale)
