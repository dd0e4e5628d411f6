"""Feature scaling on the long matrix (X1-X4), as expressions.

Fit = one aggregate per feature (mean, population std, min, max) plus exact
quartiles; transform = a join of the per-feature parameter table (one row per
feature column - a bounded table) followed by an arithmetic projection.
NULL values are ignored while fitting and stay NULL.  A zero scale is
replaced by 1, like the usual library scalers.  Spark ML scalers are not used
on purpose: their standard deviation is the sample one and their robust
quantiles are approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..session import small_side

METHODS = ("standard", "minmax", "robust")


def fit_params(fx: DataFrame, methods: Sequence[str] = ("robust",), feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, method, center, scale) for every requested method, in one pass
    (plus one quartile pass when 'robust' is requested)."""
    methods = list(methods)
    bad = [m for m in methods if m not in METHODS]
    if bad or not methods:
        raise ValueError(f"unknown scaling methods {bad}; choose from {METHODS}")
    v = F.col(value).cast("double")
    stats = fx.groupBy(feature).agg(
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), F.min(v).alias("_min"), F.max(v).alias("_max")
    )
    if "robust" in methods:
        q = exact_quantiles(fx, [feature], value, [0.25, 0.5, 0.75], names=["_q1", "_med", "_q3"])
        stats = stats.join(q, feature, "left")
    rows = []
    for m in methods:
        if m == "standard":
            center, scale = F.col("_mean"), F.col("_std")
        elif m == "minmax":
            center, scale = F.col("_min"), F.col("_max") - F.col("_min")
        else:
            center, scale = F.col("_med"), F.col("_q3") - F.col("_q1")
        scale = F.when(scale.isNull() | (scale == 0), F.lit(1.0)).otherwise(scale)
        rows.append(F.struct(F.lit(m).alias("method"), center.alias("center"), scale.alias("scale")))
    return small_side(stats.select(feature, F.explode(F.array(*rows)).alias("_p")).select(feature, "_p.*"))


def apply_params(fx: DataFrame, params: DataFrame, method: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Transform with fitted parameters (reusable on new data)."""
    p = params.where(F.col("method") == method).select(feature, "center", "scale")
    out = fx.join(p, feature, "left").withColumn(value, (F.col(value) - F.col("center")) / F.col("scale"))
    return out.drop("center", "scale")


def scale(fx: DataFrame, method: str = "robust", feature: str = "feature", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """X1 (standard) / X2 (minmax) / X3 (robust): returns (scaled fx, params)."""
    params = fit_params(fx, [method], feature, value)
    return apply_params(fx, params, method, feature, value), params


def scale_all(fx: DataFrame, methods: Sequence[str] = ("robust",), feature: str = "feature", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Every method from one fitted parameter table; the scaled output has a
    ``method`` column."""
    params = fit_params(fx, methods, feature, value)
    out = fx.join(params, feature, "left").withColumn(value, (F.col(value) - F.col("center")) / F.col("scale"))
    return out.drop("center", "scale"), params
