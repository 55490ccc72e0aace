"""Tail probabilities that Spark SQL lacks, as Arrow-batched column functions.

They run on result tables with one row per test, never on the case table.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .splitting import log_binomial

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * lead
    return lead * _lentz(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)


def _lentz(step, b0: float) -> float:
    """1 / (b0 + a1/(b1 + a2/(b2 + ...))) for step(i) = (a_i, b_i)."""
    tiny = 1e-300
    f = b0 or tiny
    c, d = f, 0.0
    i = 0
    while True:
        i += 1
        a, b = step(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        delta = c * d
        f *= delta
        if abs(delta - 1.0) < 1e-15 or i > 100_000:
            return 1.0 / f


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)
_PANELS = 8
_LARGE = 2_000.0  # above this the incomplete beta function is integrated, below it a continued fraction is short


def _beta_density_factor(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x^a (1 - x)^b / B(a, b), accurate for any size of a and b."""
    return np.exp(log_binomial(a, a + b, x)) * a * b / (a + b)


def _less_its_argument(u: np.ndarray) -> np.ndarray:
    """ln(1 + u) - u without loss near 0."""
    small = np.abs(u) < 0.02
    v = np.where(small, u, 0.0)
    series = np.zeros_like(v)
    for j in range(14, 1, -1):
        series = series * v + (1 if j % 2 else -1) / j
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, series * v * v, np.log1p(u) - u)


def _beta_integrated(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for large a + b and x up to the mean: the density, relative to that at x, integrated downwards."""
    fall = ((a - 1) - (a + b - 2) * x) / (x * (1 - x))
    bend = (a - 1) / (x * x) + (b - 1) / ((1 - x) * (1 - x))
    reach = np.minimum(x, (np.sqrt(fall * fall + 90 * bend) - fall) / bend)
    total = np.zeros_like(x)
    for panel in range(_PANELS):
        s = reach[:, None] * (panel + (_NODES + 1) / 2) / _PANELS
        power = (-fall[:, None] * s + (a - 1)[:, None] * _less_its_argument(-s / x[:, None])
                 + (b - 1)[:, None] * _less_its_argument(s / (1 - x)[:, None]))
        total += np.exp(power) @ _WEIGHTS
    return _beta_density_factor(a, b, x) / (x * (1 - x)) * total * reach / (2 * _PANELS)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for x up to the mean by Lentz's method, all rows together until each has settled."""
    out = np.ones_like(x)
    c, d = np.ones_like(x), np.zeros_like(x)
    left = np.arange(len(x))
    i = 0
    while len(left):
        i += 1
        m = i // 2
        p, q, y = a[left], b[left], x[left]
        if i % 2:
            t = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        else:
            t = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d[left] = 1 / _nonzero(1 + t * d[left])
        c[left] = _nonzero(1 + t / c[left])
        step = c[left] * d[left]
        out[left] *= step
        left = left[np.abs(step - 1) >= 1e-15] if i < 20 * _LARGE else left[:0]
    return _beta_density_factor(a, b, x) / a / out


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 1e-300, x)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) of whole a and b, row by row of the arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    turned = inside & (x > (a + 1) / (a + b + 2))
    for rows, flip in ((inside & ~turned, False), (turned, True)):
        p, q, y = (b[rows], a[rows], 1 - x[rows]) if flip else (a[rows], b[rows], x[rows])
        large = p + q > _LARGE
        part = np.empty(len(p))
        for mine, method in ((large, _beta_integrated), (~large, _beta_fraction)):
            if mine.any():
                part[mine] = method(p[mine], q[mine], y[mine])
        out[rows] = 1 - part if flip else part
    return out


def _beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        under = beta_i(a, b, mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def _known(fn, *cols: pd.Series) -> pd.Series:
    """fn over the rows without a missing value, as arrays; the others are NULL."""
    values = [c.astype("float64").to_numpy() for c in cols]
    good = ~np.any([np.isnan(v) for v in values], axis=0)
    out = np.full(len(good), np.nan)
    if good.any():
        out[good] = fn(*[v[good] for v in values])
    return pd.Series(out).astype(object).where(good, None).astype("Float64")


def rank_sum_counts(n0: int, n1: int) -> np.ndarray:
    """How many of the orders of n0 and n1 untied values give each W = 0 ... n0 n1 (Gaussian binomial coefficients)."""
    counts = np.zeros(n0 * n1 + 1)
    counts[0] = 1.0
    for i in range(1, n0 + 1):
        for j in range(len(counts) - 1, n1 + i - 1, -1):
            counts[j] -= counts[j - n1 - i]
        for j in range(i, len(counts)):
            counts[j] += counts[j - i]
    return counts


def _per_row(fn, *cols: pd.Series) -> pd.Series:
    values = zip(*[c.astype("float64").to_numpy() for c in cols])
    return pd.Series([None if any(np.isnan(v) for v in row) else fn(*row) for row in values],
                     dtype="float64")


@F.pandas_udf(DoubleType())
def binom_upper_tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= x) for X ~ Binomial(n, p)."""
    def tail(x, n, p):
        inner = np.clip(x, 1, np.maximum(n, 1))
        return np.where(x <= 0, 1.0, np.where(x > n, 0.0, beta_i(inner, np.maximum(n - inner, 0) + 1, p)))
    return _known(tail, x, n, p)


@F.pandas_udf(DoubleType())
def binom_lower_limit(x: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    """Exact lower confidence limit for a binomial share."""
    return _known(lambda x, n, a: np.where(x == 0, 0.0, _beta_quantile(a / 2, np.maximum(x, 1), n - np.maximum(x, 1) + 1)), x, n, alpha)


@F.pandas_udf(DoubleType())
def binom_upper_limit(x: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    """Exact upper confidence limit for a binomial share."""
    return _known(lambda x, n, a: np.where(x == n, 1.0, _beta_quantile(1 - a / 2, x + 1, np.maximum(n - x, 1))), x, n, alpha)


@F.pandas_udf(DoubleType())
def rank_sum_two_sided(w: pd.Series, n0: pd.Series, n1: pd.Series) -> pd.Series:
    """Exact two-sided p of the rank-sum statistic W of untied values: twice the smaller tail, at most 1."""
    def tail(w, n0, n1):
        out = np.empty(len(w))
        for a, b in set(zip(n0.tolist(), n1.tolist())):
            mine = (n0 == a) & (n1 == b)
            counts = rank_sum_counts(int(a), int(b))
            below, above = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
            at = np.round(w[mine]).astype(int)
            out[mine] = np.minimum(1.0, 2 * np.minimum(below[at], above[at]) / below[-1])
        return out
    return _known(tail, w, n0, n1)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) for a standard normal."""
    return _per_row(lambda z: math.erfc(abs(z) / math.sqrt(2.0)), z)


@F.pandas_udf(DoubleType())
def chi2_upper_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) for a chi-squared variable."""
    return _per_row(lambda x, k: _gamma_q(k / 2, x / 2), x, df)
