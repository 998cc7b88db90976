"""Tail probabilities that Spark SQL lacks, in plain Python over Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        k = i * (a - i)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, tiny = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300), 1e-300
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def normal_quantile(p: float) -> float:
    """The standard normal's quantile, by bisection on its tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


#: The polynomials of Royston's published approximation, lowest power first.
_C1, _C2 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_G, _C3, _C4 = (-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_C5, _C6 = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(a * x**i for i, a in enumerate(c))


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and its p value for 3 to 5,000 values; NaN for fewer, or without spread."""
    x, n = sorted(values), len(values)
    if n < 3 or x[-1] == x[0]:
        return float("nan"), float("nan")
    m = [normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss, u = sum(v * v for v in m), 1 / math.sqrt(n)
    a = [v / math.sqrt(ss) for v in m]
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = _poly(_C1, u) + a[-1]
        if n <= 5:
            phi, edge = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2), {0: -last, n - 1: last}
        else:
            next_ = _poly(_C2, u) + a[-2]
            phi, edge = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2), {0: -last, 1: -next_, n - 2: next_, n - 1: last}
        a = [edge.get(i, v / math.sqrt(phi)) for i, v in enumerate(m)]
    mean = sum(x) / n
    w = min(1.0, sum(c * v for c, v in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 1.90985931710274 * (math.asin(math.sqrt(w)) - 1.04719755119660))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = _poly(_G, n)
        if y >= g:
            return w, 1e-99
        y, mu, sd = -math.log(g - y), _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        mu, sd = _poly(_C5, math.log(n)), math.exp(_poly(_C6, math.log(n)))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def _each(f):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return _each(normal_sf2)(z)


@F.pandas_udf(DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_sf2)(t, df)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_sf)(x, df)
