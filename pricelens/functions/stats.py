"""Student-t p-values for Pearson correlations without SciPy.

Two-sided p of r with n pairs: df = n - 2 and p = I_x(df/2, 1/2) at
x = 1 - r^2, the regularised incomplete beta function.  It is evaluated from
the published continued fraction (DLMF 8.17.22), from the inside out, for all
rows of a batch at once; the depth is doubled until two depths agree.  It runs
in a pandas UDF over the k^2 rows of a correlation table only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAX_DEPTH = 1 << 17
AGREE = 1e-13


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) of DLMF 8.17.22, cut after ``depth``
    pairs of terms."""
    tail = np.ones_like(x)
    for m in range(depth, -1, -1):
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1.0 + odd / tail
        if m:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            tail = 1.0 + even / tail
    return 1.0 / tail


def betainc_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) element by element; raises when the fraction does not settle."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0.0, 0.0, 1.0)
    inside = (x > 0.0) & (x < 1.0)
    a, b, x = a[inside], b[inside], x[inside]
    mirror = x > (a + 1.0) / (a + b + 2.0)  # I_x(a, b) = 1 - I_{1-x}(b, a) converges faster there
    a, b, x = np.where(mirror, b, a), np.where(mirror, a, b), np.where(mirror, 1.0 - x, x)
    lead = np.array([math.lgamma(p + q) - math.lgamma(p + 1.0) - math.lgamma(q) for p, q in zip(a, b)])
    front = np.exp(lead + a * np.log(x) + b * np.log1p(-x))
    depth, value = 16, _fraction(a, b, x, 16)
    while True:
        depth *= 2
        finer = _fraction(a, b, x, depth)
        if np.all(np.abs(finer - value) <= AGREE * np.abs(finer)):
            break
        if depth > MAX_DEPTH:
            raise ArithmeticError("incomplete beta function: no convergence")
        value = finer
    part = front * finer
    out[inside] = np.where(mirror, 1.0 - part, part)
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    return float(betainc_array([a], [b], [x])[0])


def pearson_p_array(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Pearson correlations over n complete pairs (NaN
    below 3 pairs or for an undefined r)."""
    r, n = np.asarray(r, dtype=float), np.asarray(n, dtype=float)
    out = np.full(len(r), np.nan)
    ok = ~np.isnan(r) & (n >= 3)
    rr = np.clip(r[ok], -1.0, 1.0)
    out[ok] = betainc_array((n[ok] - 2.0) / 2.0, 0.5, (1.0 - rr) * (1.0 + rr))
    return out


def pearson_p(r: float, n: int) -> float | None:
    """``pearson_p_array`` of one pair; None where it is undefined."""
    p = pearson_p_array([np.nan if r is None else r], [np.nan if n is None else n])[0]
    return None if np.isnan(p) else float(p)


@F.pandas_udf(DoubleType())
def _p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(pearson_p_array(r.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float, na_value=np.nan)))


def pearson_pvalue(r: str | Column, n: str | Column) -> Column:
    rc = F.col(r) if isinstance(r, str) else r
    nc = F.col(n) if isinstance(n, str) else n
    p = _p_udf(rc.cast("double"), nc.cast("long"))
    return F.when(F.isnan(p), F.lit(None).cast("double")).otherwise(p)
