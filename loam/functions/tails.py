"""Tail probabilities of test statistics, for one number on the driver."""

from __future__ import annotations

import math


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of a chi-square variable: the regularised upper incomplete gamma function, by its series or continued fraction."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def correlation_tail(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees."""
    if r is None or n < 3:
        return None
    return beta_share((n - 2) / 2, 0.5, max(0.0, 1 - r * r))
