"""Tail probabilities of test statistics, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(step, n: int, shape) -> np.ndarray:
    """Lentz's evaluation of a continued fraction with terms ``step(k)`` = (a, b)."""
    tiny = 1e-300
    a, b = step(0)
    f = np.where(np.abs(b) < tiny, tiny, b) * np.ones(shape)
    c, d = f.copy(), np.zeros(shape)
    for k in range(1, n):
        a, b = step(k)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + a / np.where(np.abs(c) < tiny, tiny, c)
        f = f * c * d
    return f


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)

    def step(k):
        if k == 0:
            return 0.0, np.ones_like(z)
        m = k // 2
        if k == 1:
            return np.ones_like(z), np.ones_like(z)
        j = k - 1
        m = j // 2
        if j % 2:
            return -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)), 1.0
        return m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), 1.0

    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        # 1 + 1/(1 + d1/(1 + ...)) - 1 is the fraction itself
        value = front * (_fraction(step, 300, z.shape) - 1)
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, value))
    return np.where(flip, 1 - value, value)


def gammaincc(a, x) -> np.ndarray:
    """The regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = total = 1 / a
        for k in range(1, 500):
            term = term * x / (a + k)
            total = total + term
        low = 1 - front * total
        high = front / _fraction(lambda k: (0.0, x + 1 - a) if k == 0 else (-k * (k - a), x + 2 * k + 1 - a), 300, x.shape)
    return np.where(x <= 0, out, np.where(x < a + 1, low, high))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_upper(x, df) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_two_sided(z) -> np.ndarray:
    return chi2_upper(np.asarray(z, float) ** 2, np.ones_like(np.asarray(z, float)))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _phi(x):
    return 0.5 * _erfc(-np.asarray(x) / math.sqrt(2)).astype(float)


def studentised_range_upper(q, k, df) -> np.ndarray:
    """P(Q > q) for ``k`` means and ``df`` degrees of freedom, by two Gauss-Legendre integrals."""
    out = []
    z = 8 * _NODES
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    for q_, k_, v in zip(*(np.atleast_1d(np.asarray(a, float)) for a in np.broadcast_arrays(q, k, df))):
        if not (np.isfinite(q_) and np.isfinite(v) and v > 0):
            out.append(np.nan)
            continue
        width = 8 / np.sqrt(2 * v)
        low, high = max(1e-9, 1 - width), 1 + 1.5 * width
        s = (high - low) / 2 * _NODES + (high + low) / 2
        log_s = np.log(2) + v / 2 * np.log(v / 2) - _lgamma(v / 2) + (v - 1) * np.log(s) - v * s * s / 2
        inner = 8 * k_ * (np.clip(_phi(z) - _phi(z - q_ * s[:, None]), 0, 1) ** (k_ - 1)) @ (_WEIGHTS * density)
        out.append(1 - (high - low) / 2 * np.sum(_WEIGHTS * np.exp(log_s) * inner))
    return np.clip(np.array(out), 0, 1)


def _wrap(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def p(*args: pd.Series) -> pd.Series:
        values = [np.asarray(a, float) for a in args]
        good = np.all([np.isfinite(v) for v in values], axis=0) if len(values[0]) else np.empty(0, bool)
        out = np.full(len(values[0]), np.nan)
        if good.any():
            out[good] = function(*[v[good] for v in values])
        return pd.Series(out).where(~np.isnan(out), None)

    return p(*[c.cast("double") for c in columns])


def p_t(t: Column, df: Column) -> Column:
    return _wrap(t_two_sided, t, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _wrap(f_upper, f, d1, d2)


def p_chi2(x: Column, df: Column) -> Column:
    return _wrap(chi2_upper, x, df)


def p_normal(z: Column) -> Column:
    return _wrap(normal_two_sided, z)


def p_range(q: Column, k: Column, df: Column) -> Column:
    return _wrap(studentised_range_upper, q, k, df)
