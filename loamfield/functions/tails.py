"""Tail probabilities and tests in closed form or series, for result rows, not for data rows."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, df: int = 1) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    return 1.0 - _gamma_lower(df / 2, x / 2) if x < df + 2 else _gamma_upper(df / 2, x / 2)


def _gamma_lower(a: float, x: float) -> float:
    term = total = 1 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_upper(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_regularised(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation by Student's t; null with fewer than three pairs."""
    if n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables with its margins that are no likelier than it."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    log = [math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1) for x in range(lo, hi + 1)]
    top = max(log)
    p = [math.exp(x - top) for x in log]
    limit = p[a - lo] * (1 + 1e-7)
    return min(1.0, sum(x for x in p if x <= limit) / sum(p))


def _normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by bisection on erfc and one Newton step."""
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def shapiro_wilk(values: np.ndarray) -> tuple[float, float] | None:
    """W and p by Royston's 1995 approximation, for 3 to 5000 values; null where all are equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return None
    half = n // 2
    if n == 3:
        weights = np.array([math.sqrt(0.5)])
    else:
        m = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
        total = 2 * float(m @ m)
        root, u = math.sqrt(total), 1 / math.sqrt(n)
        # Polynomials of the published approximation, in descending powers of 1/sqrt(n).
        first = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], u) - m[0] / root
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) - m[1] / root
            scale = math.sqrt((total - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * first**2 - 2 * second**2))
            weights = np.concatenate([[first, second], -m[2:] / scale])
        else:
            scale = math.sqrt((total - 2 * m[0] ** 2) / (1 - 2 * first**2))
            weights = np.concatenate([[first], -m[1:] / scale])
    centred = x - x.mean()
    w = min(1.0, float(weights @ (x[::-1][:half] - x[:half])) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        v = math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
