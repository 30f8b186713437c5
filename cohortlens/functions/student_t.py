"""Student t distribution for small result tables, vectorized over Arrow batches.

Spark has no such function. The tables it runs on hold one row per model and metric.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (Lentz's method)."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 1000):
        before = h
        for numerator in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    log_beta = np.array([lgamma(i) + lgamma(j) - lgamma(i + j) for i, j in zip(p, q)])
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) / p
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Probability of a value at least as far from zero."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    out = np.full(t.shape, np.nan)
    if ok.any():
        out[ok] = _incomplete_beta(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    out[np.isinf(t)] = 0.0
    return out


def quantile(prob: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper quantile for probabilities of one half and more, by bisection."""
    prob, df = np.asarray(prob, float), np.asarray(df, float)
    out = np.full(prob.shape, np.nan)
    ok = df > 0
    if not ok.any():
        return out
    tail, d = 2 * (1 - prob[ok]), df[ok]
    low, high = np.zeros_like(d), np.ones_like(d)
    while (short := two_sided_p(high, d) > tail).any():
        high = np.where(short, high * 2, high)
    for _ in range(80):
        mid = (low + high) / 2
        above = two_sided_p(mid, d) > tail
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    out[ok] = (low + high) / 2
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_quantile(prob: pd.Series, df: pd.Series) -> pd.Series:
    p, d = prob.to_numpy(float), df.to_numpy(float)
    # Few distinct sample sizes occur: solve each once.
    pairs, where = np.unique(np.stack([p, d], axis=1), axis=0, return_inverse=True)
    return pd.Series(quantile(pairs[:, 0], pairs[:, 1])[where.reshape(-1)])
