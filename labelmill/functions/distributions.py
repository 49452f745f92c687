"""The F distribution, for confidence limits of a few result rows."""

from __future__ import annotations

from math import exp, lgamma, log


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's way of evaluating it)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) * total / a


def f_quantile(p: float, m: float, n: float) -> float:
    """Where the F distribution of m and n degrees of freedom reaches p, by halving."""
    low, high = 0.0, 1.0
    while incomplete_beta(m / 2, n / 2, m * high / (m * high + n)) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if incomplete_beta(m / 2, n / 2, m * mid / (m * mid + n)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
