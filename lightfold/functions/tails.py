"""Upper tails as vectorised pandas functions: Spark has no log-gamma or erfc."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def poisson_tail(k: float, mean: float) -> float:
    """P(X >= k), summed from the small side so that tiny tails keep their digits."""
    k = math.ceil(k)
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    log = lambda n: n * math.log(mean) - mean - math.lgamma(n + 1)
    if k > mean:
        top, total, n = log(k), 0.0, k
        while True:
            term = math.exp(log(n) - top)
            total += term
            if term < total * 1e-17:
                return min(1.0, math.exp(top) * total) if top > -745 else 0.0
            n += 1
    return max(0.0, 1.0 - math.fsum(math.exp(log(n)) for n in range(k)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k > n * p:
        return min(1.0, math.fsum(math.exp(log(i)) for i in range(k, n + 1)))
    return max(0.0, 1.0 - math.fsum(math.exp(log(i)) for i in range(k)))


def gaussian_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def _each(f, *cols: pd.Series) -> pd.Series:
    """f of each row, computed once for each different row of arguments; null where one is."""
    ok = np.logical_and.reduce([c.notna().to_numpy() for c in cols])
    out = np.full(len(ok), np.nan)
    if ok.any():
        different, of = np.unique(np.stack([c[ok].to_numpy(float) for c in cols], 1), axis=0, return_inverse=True)
        out[ok] = np.array([f(*row) for row in different.tolist()])[of.ravel()]
    return pd.Series(out)


def _udf(f):
    # made when a query is built: workers import this module without a session
    return F.pandas_udf(f, "double")


def poisson_upper(k, mean):
    """P(X >= k) of a Poisson column."""

    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return _each(poisson_tail, k, mean)

    return _udf(tail)(k, mean)


def binomial_upper(k, n, p):
    """P(X >= k) of a binomial column."""

    def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return _each(lambda a, b, c: binomial_tail(int(a), int(b), c), k, n, p)

    return _udf(tail)(k, n, p)


def gaussian_upper(x):
    def tail(x: pd.Series) -> pd.Series:
        return _each(gaussian_tail, x)

    return _udf(tail)(x)
