"""Distribution functions for test statistics, vectorised in numpy, and Arrow UDFs over them.

They run on aggregated rows (one per entity, test or coefficient), never on events.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_gamma(p + q) - _gamma(p) - _gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def gamma_tail(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function."""
    s, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (s, x)))
    low = x < s + 1
    with np.errstate(all="ignore"):
        front = np.exp(s * np.log(x) - x - _gamma(s))
        term = total = 1 / s
        for n in range(1, 500):
            term = term * x / (s + n)
            total = total + term
        b = x + 1 - s
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for n in range(1, 500):
            an = -n * (n - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
    return np.where(x <= 0, 1.0, np.where(low, 1 - front * total, front * h))


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return gamma_tail(np.asarray(dof, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, dtype=float))


def _over_known(f, *cols: pd.Series) -> pd.Series:
    """f where all arguments are known, else missing."""
    ok = np.logical_and.reduce([c.notna().to_numpy() for c in cols])
    out = np.full(len(cols[0]), np.nan)
    if ok.any():
        out[ok] = f(*[c.to_numpy(dtype=float)[ok] for c in cols])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _over_known(t_two_sided, t, dof)


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over_known(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over_known(chi2_tail, x, dof)
