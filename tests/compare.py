"""Order-insensitive comparison of a Spark result with an oracle result."""

import math

import numpy as np
import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


def assert_same(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame):
    c1, r1 = rows(spark_pdf)
    c2, r2 = rows(oracle_pdf)
    assert c1 == c2, (c1, c2)
    assert len(r1) == len(r2), (len(r1), len(r2))
    diff = [(a, b) for a, b in zip(r1, r2) if a != b]
    assert not diff, diff[:3]
