"""Distribution functions as pandas UDFs over numpy arrays; Spark has no error function."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Smallest positive double: p-values of zero are raised to it.
TINY = 2.2250738585072014e-308


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function for x >= 0: a series below 2, a continued fraction from there."""
    x = np.asarray(x, np.float64)
    low = np.where(x < 2, x, 0.0)
    term = total = low.copy()
    for n in range(1, 60):
        term = term * 2 * low * low / (2 * n + 1)
        total = total + term
    series = 1 - 2 / np.sqrt(np.pi) * np.exp(-low * low) * total
    high = np.where(x < 2, 2.0, x)
    below = high
    for n in range(120, 0, -1):
        below = high + n / 2 / below
    return np.where(x < 2, series, np.exp(-high * high) / np.sqrt(np.pi) / below)


def normal_lower(z: np.ndarray) -> np.ndarray:
    """P(Z <= z) for z <= 0."""
    return 0.5 * erfc(-z / np.sqrt(2))


def quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal quantile for p from the smallest double to 1, by Halley steps on the nearer tail."""
    p = np.clip(np.asarray(p, np.float64), TINY, 1.0)
    tail = np.maximum(np.minimum(p, 1 - p), TINY)
    t = np.sqrt(-2 * np.log(tail))
    z = np.minimum(-(t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)), 0.0)
    for _ in range(5):
        e = (normal_lower(z) - tail) * np.sqrt(2 * np.pi) * np.exp(np.minimum(z * z / 2, 709.0))
        z = np.minimum(z - e / (1 + z * e / 2), 0.0)
    return np.where(p < 0.5, z, -z)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series above 12."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = shift + np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    # coefficients B_2k / (2k (2k - 1)) of Bernoulli's numbers
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / safe(1 + step * d)
            c = safe(1 + step / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    turn = y >= (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - y, y)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * np.log(z) + q * np.log1p(-z))
    part = front * _beta_fraction(p, q, z) / p
    return np.where(inside, np.where(turn, 1 - part, part), (x >= 1).astype(float))


def _with_nulls(values: np.ndarray, known: np.ndarray) -> pd.Series:
    return pd.Series(np.where(known, values, np.nan)).astype(object).where(pd.Series(known), None)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of a standard normal; null stays null."""
    x = z.to_numpy(np.float64, na_value=np.nan)
    known = ~np.isnan(x)
    return _with_nulls(erfc(np.abs(np.where(known, x, 0.0)) / np.sqrt(2)), known)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The standard normal quantile of p; small p are exact, so take the lower tail of a small p-value."""
    x = p.to_numpy(np.float64, na_value=np.nan)
    known = ~np.isnan(x)
    return _with_nulls(quantile(np.where(known, x, 0.5)), known)


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's t with df degrees of freedom; null stays null."""
    a, b = t.to_numpy(np.float64, na_value=np.nan), df.to_numpy(np.float64, na_value=np.nan)
    known = ~(np.isnan(a) | np.isnan(b))
    a, b = np.where(known, a, 0.0), np.where(known, b, 1.0)
    return _with_nulls(incomplete_beta(b / 2, np.full_like(b, 0.5), b / (b + a * a)), known)


@lru_cache(maxsize=256)
def rank_sum_tail(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u from 0 to half of m n, where groups of m and n different values meet by chance.

    The number of arrangements with each u are the coefficients of a Gaussian
    binomial: m times a product with 1 - q^(n + i) and a quotient by 1 - q^i.
    Lower coefficients follow from lower ones alone, so the tail is precise.
    """
    m, n = min(m, n), max(m, n)
    size = m * n // 2 + 1
    count = np.zeros(size)
    count[0] = 1.0
    for i in range(1, m + 1):
        shift = n + i
        if shift < size:
            count[shift:] -= count[:-shift].copy()
        padded = np.append(count, np.zeros(-size % i))
        count = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[:size]
    log_all = log_gamma(np.array([m + n + 1.0])) - log_gamma(np.array([m + 1.0])) - log_gamma(np.array([n + 1.0]))
    every = np.exp(log_all)[0]
    return np.cumsum(count) / (np.round(every) if every < 2**53 else every)


@F.pandas_udf(DoubleType())
def exact_rank_two_sided(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    """The exact two-sided p of a rank-sum statistic without ties; null stays null."""
    a, b, c = (x.to_numpy(np.float64, na_value=np.nan) for x in (u, m, n))
    known = ~(np.isnan(a) | np.isnan(b) | np.isnan(c))
    out = np.zeros(len(a))
    for i in np.flatnonzero(known):
        nearer = min(a[i], b[i] * c[i] - a[i])
        out[i] = min(1.0, 2 * rank_sum_tail(int(min(b[i], c[i])), int(max(b[i], c[i])))[int(nearer)])
    return _with_nulls(out, known)


def hypergeometric(k: np.ndarray, drawn: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P(X >= k) when ``drawn`` of ``total`` are drawn and ``marked`` of them are marked."""
    k, n, m, t = (np.asarray(v, np.float64) for v in (k, drawn, marked, total))
    least, most = np.maximum(0.0, n - (t - m)), np.minimum(n, m)
    # at or below the peak the terms under k are summed, downwards from the largest, as the first term from k on may be too small for a double
    peak = np.floor((n + 1) * (m + 1) / (t + 2))
    below = (k > least) & (k <= np.minimum(peak, most))
    i = np.where(below, k - 1, np.maximum(k, least))
    some = i <= most
    choose = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
    at = np.where(some, i, least)
    term = np.where(some, np.exp(choose(m, at) + choose(t - m, n - at) - choose(t, n)), 0.0)
    out, live = term.copy(), np.flatnonzero(some)
    live = live[np.where(below[live], at[live] > least[live], at[live] < most[live])]
    while len(live):
        down = below[live]
        # the ratio of the terms at j + 1 and j
        j = at[live] - down
        ratio = (m[live] - j) * (n[live] - j) / ((j + 1) * (t[live] - m[live] - n[live] + j + 1))
        term[live] *= np.where(down, 1 / ratio, ratio)
        out[live] += term[live]
        at[live] += np.where(down, -1, 1)
        live = live[np.where(down, at[live] > least[live], at[live] < most[live]) & (term[live] > out[live] * 1e-18)]
    return np.where(k <= least, 1.0, np.clip(np.where(below, 1 - out, out), 0.0, 1.0))


@F.pandas_udf(DoubleType())
def hypergeometric_tail(k: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= k) when ``drawn`` of ``total`` are drawn and ``marked`` of them are marked."""
    return pd.Series(hypergeometric(*(v.to_numpy(np.float64) for v in (k, drawn, marked, total))))
