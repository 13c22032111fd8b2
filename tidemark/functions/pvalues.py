"""Tail probabilities of the rank tests, in plain Python (no statistics library is needed)."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def z_of(level: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: regularised incomplete gamma by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, t = df / 2.0, x / 2.0
    front = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = t + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided. Exact for small samples without ties, else normal with tie and continuity correction. ``ties``: sum of t^3 - t."""
    big = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        total = math.comb(n1 + n2, n1)
        ways = [0] * (n1 * n2 + 1)
        ways[0] = 1
        for j in range(1, n1 + 1):
            for i in range(len(ways) - 1, n2 + j - 1, -1):
                ways[i] -= ways[i - n2 - j]
            for i in range(j, len(ways)):
                ways[i] += ways[i - j]
        return min(1.0, 2.0 * sum(ways[math.ceil(big) :]) / total)
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if var <= 0:
        return 1.0
    return min(1.0, 2.0 * normal_sf((big - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)))


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided signed-rank test of ``n`` non-zero differences; ``w`` the smaller rank sum."""
    if n == 0:
        return 1.0
    if ties == 0 and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for i in range(len(ways) - 1, r - 1, -1):
                ways[i] += ways[i - r]
        return min(1.0, 2.0 * sum(ways[: math.floor(w) + 1]) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return min(1.0, 2.0 * normal_sf((n * (n + 1) / 4.0 - w) / math.sqrt(var))) if var > 0 else 1.0
