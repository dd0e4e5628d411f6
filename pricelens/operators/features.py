"""Per entity x item (x period) features and the feature matrix.

Averages and volatility take one hash aggregate, combined map-side, so a hot
(entity, item) group costs one small buffer per map task.  The trend counts
days from a group's first priced observation, which is known only after the
scan.  Rows are therefore reduced once to mergeable regression states, one per
(entity, item, period, timestamp): row count, count, sum, squared deviations,
least and greatest value.  Origin, mean and slope come from that table; the
rows of the panel are read once and never joined.

The matrix is produced in long form ``(entity, feature, value)`` (canonical),
as one ordered vector per entity, or pivoted wide for export.  Items and
periods travel as a one-row table, so the plan does not grow with the columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elapsed_days, period_label
from ..functions.quantiles import exact_quantiles
from ..session import broadcast_checked, checkpoint

FEATURES = ("avg", "cv", "trend")
TREND_METHODS = ("linear_regression", "simple_slope")


# ----------------------------------------------------------------- A1 - A4
def feature_avg(value: str = "Price") -> Column:
    """A1: mean of non-null values."""
    return F.avg(F.col(value))


def feature_cv(value: str = "Price") -> Column:
    """A2: sample std / mean; NULL with fewer than two values or a zero mean."""
    v = F.col(value)
    return F.when(F.count(v) >= 2, F.try_divide(F.stddev_samp(v), F.avg(v)))


def regression_states(df: DataFrame, keys: Sequence[str], ts: str = "Date", value: str = "Price") -> DataFrame:
    """One mergeable state per group and timestamp: (_g struct of the keys, _t, _rows, _n, _s, _m2,
    _lo, _hi).  The only pass over the rows; checkpointed, since origin and slope both read it."""
    v = F.col(value).cast("double")
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    d = df.select(group.alias("_g"), F.col(ts).alias("_t"), v.alias("_v"))
    return checkpoint(d.groupBy("_g", "_t").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_n"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.var_pop("_v") * F.count("_v"), F.lit(0.0)).alias("_m2"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))


def merged_features(states: DataFrame, keys: Sequence[str], method: str = "linear_regression") -> DataFrame:
    """Merge the states of each group: ``keys`` + rows, avg, cv and trend.

    Trend (A3/A4) over whole days since the group's first priced observation:

    * linear_regression: OLS slope per day; NULL below 3 values; 0.0 when all
      days are equal (least-squares minimum-norm answer).
    * simple_slope: (last - first) / days between them; ties on the date are
      broken by the value (first = lowest, last = highest).
    """
    if method not in TREND_METHODS:
        raise ValueError(f"unknown trend method {method!r}")
    priced = F.col("_n") > 0
    origin = states.groupBy("_g").agg(F.min(F.when(priced, F.col("_t"))).alias("_t0"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("_mu"))
    side = broadcast_checked(origin.withColumnRenamed("_g", "_og"))
    d = states.join(side, F.col("_g").eqNullSafe(F.col("_og")), "left")
    x = F.when(priced, elapsed_days("_t", "_t0"))
    d = d.withColumns({"_x": x, "_b": F.when(priced, F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("_mu"), 2))})
    n, sy = F.sum("_n"), F.sum("_s")
    sx, sxx, sxy = F.sum(F.col("_n") * F.col("_x")), F.sum(F.col("_n") * F.col("_x") * F.col("_x")), F.sum(F.col("_x") * F.col("_s"))
    span = F.max("_x") - F.min("_x")
    if method == "linear_regression":
        trend = F.when(n < 3, F.lit(None).cast("double")).when(span == 0, F.lit(0.0)).otherwise(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))
    else:
        at = F.when(priced, F.col("_t"))
        trend = F.when((n < 3) | (span == 0), F.lit(None).cast("double")).otherwise(F.try_divide(F.max_by("_hi", at) - F.min_by("_lo", at), span))
    std = F.sqrt((F.sum("_m2") + F.coalesce(F.sum("_b"), F.lit(0.0))) / F.nullif(n - 1, F.lit(0)))
    out = d.groupBy("_g").agg(
        F.sum("_rows").alias("rows"), F.try_divide(sy, n).alias("avg"),
        F.when(n >= 2, F.try_divide(std, F.try_divide(sy, n))).alias("cv"), trend.alias("trend"))
    return out.select(*[F.col(f"_g.k{i}").alias(k) for i, k in enumerate(keys)], "rows", "avg", "cv", "trend")


def feature_trend(df: DataFrame, keys: Sequence[str], ts: str = "Date", value: str = "Price", method: str = "linear_regression") -> DataFrame:
    """A3/A4: ``keys`` + trend, one row per group."""
    return merged_features(regression_states(df, keys, ts, value), keys, method).select(*keys, "trend")


# ----------------------------------------------------------------- A5 / A6
def feature_values(
    df: DataFrame,
    features: Sequence[str] = ("avg",),
    freq: str = "all",
    min_points: int = 10,
    trend_method: str = "linear_regression",
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
    value: str = "Price",
) -> DataFrame:
    """Sparse feature table: one row per observed (entity, item, period) with
    one column per feature (NULL when the group has fewer than
    ``min_points`` rows, nulls included)."""
    features = _check_features(features, min_points, trend_method)
    d = df.select(entity, item, ts, F.col(value).cast("double").alias(value))
    d = d.withColumn("_period", period_label(ts, freq))
    keys = [entity, item, "_period"]
    if "trend" in features:
        m = merged_features(regression_states(d, keys, ts, value), keys, trend_method)
        return m.select(*keys, *[F.when(F.col("rows") >= min_points, F.col(f)).alias(f) for f in features])
    enough = F.count(F.lit(1)) >= min_points
    exprs = {"avg": feature_avg(value), "cv": feature_cv(value)}
    return d.groupBy(*keys).agg(*[F.when(enough, exprs[f]).alias(f) for f in features])


def feature_matrix(
    df: DataFrame,
    features: Sequence[str] = ("avg",),
    freq: str = "all",
    min_points: int = 10,
    trend_method: str = "linear_regression",
    wide: bool = True,
    items: Sequence[str] | None = None,
    periods: Sequence[str] | None = None,
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
    value: str = "Price",
) -> DataFrame:
    """Dense feature matrix over every entity x item (x period).

    Long form: ``(entity, item, period, type, feature, value)``; wide form:
    one row per entity, columns ``{item}_{feature}`` or
    ``{item}_{feature}_{period}`` in item, feature, period order.  ``items`` and
    ``periods`` default to the distinct values present."""
    long, names = matrix_long(df, features, freq, min_points, trend_method, items, periods, entity, item, ts, value)
    return to_wide(long, names, entity) if wide else long


def matrix_long(
    df: DataFrame,
    features: Sequence[str] = ("avg",),
    freq: str = "all",
    min_points: int = 10,
    trend_method: str = "linear_regression",
    items: Sequence[str] | None = None,
    periods: Sequence[str] | None = None,
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
    value: str = "Price",
) -> tuple[DataFrame, list[str]]:
    """Long dense matrix plus the ordered list of feature column names."""
    cells, dims = _dense(df, features, freq, min_points, trend_method, items, periods, entity, item, ts, value)
    names = [n for _, n in feature_names(dims[0], list(features), dims[1], freq)]
    return cells.select(entity, item, "period", "type", "feature", "value"), names


def matrix_vector(
    df: DataFrame,
    features: Sequence[str] = ("avg",),
    freq: str = "all",
    min_points: int = 10,
    trend_method: str = "linear_regression",
    items: Sequence[str] | None = None,
    periods: Sequence[str] | None = None,
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
    value: str = "Price",
) -> DataFrame:
    """P6 without the wide table: (entity, features array<double>, names array<string>) in item,
    feature, period order.  One exchange by entity, and no expression per column."""
    cells, _ = _dense(df, features, freq, min_points, trend_method, items, periods, entity, item, ts, value)
    rows = cells.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_pos", "value", "feature"))).alias("_v"))
    return rows.select(entity, F.col("_v.value").alias("features"), F.col("_v.feature").alias("names"))


def _dense(df, features, freq, min_points, trend_method, items, periods, entity, item, ts, value) -> tuple[DataFrame, tuple[list[str], list[str]]]:
    """All cells (entity, item, period, type, feature, _pos, value), and the items and periods."""
    features = _check_features(features, min_points, trend_method)
    # one row per observed (entity, item, period); the dimensions are read from it, not from the panel
    sparse = checkpoint(feature_values(df, features, freq, min_points, trend_method, entity, item, ts, value))
    seen = sparse.agg(F.sort_array(F.collect_set(item)), F.sort_array(F.collect_set("_period"))).first() if items is None or periods is None else None
    dims = (seen[0] if items is None else list(items), seen[1] if periods is None else list(periods))
    name = lambda i, f, p: F.concat_ws("_", i, F.lit(f), *([] if freq == "all" else [p]))

    def cells_of(i: Column, f: str) -> Column:
        return F.transform("periods", lambda p: F.struct(i.alias("_i"), p.alias("period"), F.lit(f).alias("type"), name(i, f, p).alias("feature")))

    columns = F.flatten(F.transform("items", lambda i: F.flatten(F.array(*[cells_of(i, f) for f in features]))))
    one = df.sparkSession.createDataFrame([(0, *dims)], "_one int, items array<string>, periods array<string>").select("_one", columns.alias("_cols"))
    entities = sparse.select(F.col(entity).alias("_e")).distinct().withColumn("_one", F.lit(0))
    grid = entities.join(one, "_one").select("_e", F.posexplode("_cols").alias("_pos", "_c")).select("_e", "_pos", "_c.*")
    observed = sparse.select(
        F.col(entity).alias("_se"), F.col(item).alias("_si"), F.col("_period").alias("_sp"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("_st"), F.col(f).alias("value")) for f in features])).alias("_f"),
    ).select("_se", "_si", "_sp", "_f._st", "_f.value")
    on = F.col("_e").eqNullSafe(F.col("_se")) & (F.col("_i") == F.col("_si")) & (F.col("period") == F.col("_sp")) & (F.col("type") == F.col("_st"))
    cells = grid.join(observed, on, "left")
    return cells.select(F.col("_e").alias(entity), F.col("_i").alias(item), "period", "type", "feature", "_pos", "value"), dims


def feature_names(items, features, periods, freq):
    out = []
    for i in items:
        for f in features:
            if freq == "all":
                out.append(((i, f, "all"), f"{i}_{f}"))
            else:
                for p in periods:
                    out.append(((i, f, p), f"{i}_{f}_{p}"))
    return out


def to_wide(long: DataFrame, columns: Sequence[str], entity: str = "City", feature: str = "feature", value: str = "value") -> DataFrame:
    """Pivot long (entity, feature, value) to one row per entity with an
    explicit column list (no extra pass to discover the values)."""
    return long.groupBy(entity).pivot(feature, list(columns)).agg(F.first(value))


def to_long(wide: DataFrame, entity: str = "City") -> DataFrame:
    """Unpivot a wide matrix to (entity, feature, value)."""
    cols = [c for c in wide.columns if c != entity]
    return wide.select(entity, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(entity, cols, "feature", "value")


def _check_features(features, min_points, trend_method):
    features = list(features)
    if not features:
        raise ValueError("at least one feature is required")
    bad = [f for f in features if f not in FEATURES]
    if bad:
        raise ValueError(f"unknown features {bad}; choose from {FEATURES}")
    if len(set(features)) != len(features):
        raise ValueError("duplicate features")
    if min_points < 1:
        raise ValueError("min_points must be at least 1")
    if trend_method not in TREND_METHODS:
        raise ValueError(f"unknown trend method {trend_method!r}")
    return features


# ----------------------------------------------------------------- A7
def feature_report(fx: DataFrame, entity: str = "City", feature: str = "feature", value: str = "value", type_col: str = "type") -> DataFrame:
    """A7 on the long matrix: (scope, name, metric, value) rows.

    scope 'matrix': entities, features, missing_total, complete_rows,
    incomplete_rows; scope 'column': missing per feature column; scope
    'type': per feature type count, min, max, mean (of column means), median
    (of column medians), std (mean of column sample stds), missing_rate."""
    if type_col not in fx.columns:
        fx = fx.withColumn(type_col, F.regexp_extract(F.col(feature), r"_(avg|cv|trend)(_[^_]*)?$", 1))
    per_entity = fx.groupBy(entity).agg(F.count_if(F.col(value).isNull()).alias("_nn"))
    m1 = per_entity.agg(
        F.count(F.lit(1)).cast("double").alias("entities"),
        F.sum("_nn").cast("double").alias("missing_total"),
        F.count_if(F.col("_nn") == 0).cast("double").alias("complete_rows"),
        F.count_if(F.col("_nn") > 0).cast("double").alias("incomplete_rows"),
        F.lit(0).alias("_k"),
    )
    m2 = fx.agg(F.count_distinct(feature).cast("double").alias("features"), F.lit(0).alias("_k"))
    matrix = m1.join(m2, "_k").drop("_k")
    matrix_rows = matrix.select(F.lit("matrix").alias("scope"), F.lit("all").alias("name"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
        for c in ["entities", "features", "missing_total", "complete_rows", "incomplete_rows"]
    ])).alias("_m")).select("scope", "name", "_m.metric", "_m.value")
    cols = fx.groupBy(feature, type_col).agg(
        F.count_if(F.col(value).isNull()).alias("_miss"),
        F.count(F.lit(1)).alias("_rows"),
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_std"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    med = exact_quantiles(fx, [feature], value, [0.5], names=["_median"])
    cols = cols.join(med, feature, "left")
    col_rows = cols.select(
        F.lit("column").alias("scope"), F.col(feature).alias("name"), F.lit("missing").alias("metric"),
        F.col("_miss").cast("double").alias("value"),
    )
    types = cols.groupBy(type_col).agg(
        F.count(F.lit(1)).cast("double").alias("count"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
        F.avg("_mean").alias("mean"),
        F.avg("_std").alias("std"),
        (F.sum("_miss") / F.sum("_rows")).alias("missing_rate"),
    )
    type_median = exact_quantiles(cols, [type_col], "_median", [0.5], names=["median"])
    types = types.join(type_median, type_col, "left")
    type_rows = types.select(F.lit("type").alias("scope"), F.col(type_col).alias("name"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in ["count", "min", "max", "mean", "median", "std", "missing_rate"]
    ])).alias("_m")).select("scope", "name", "_m.metric", "_m.value")
    return matrix_rows.unionByName(col_rows).unionByName(type_rows)


# ----------------------------------------------------------------- P6
def to_vector(matrix: DataFrame, entity: str = "City", columns: Sequence[str] | None = None) -> DataFrame:
    """Ordered feature columns -> (entity, features array<double>,
    names array<string>), keeping the names next to the values."""
    cols = list(columns) if columns is not None else [c for c in matrix.columns if c != entity]
    return matrix.select(
        entity,
        F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("features"),
        F.array(*[F.lit(c) for c in cols]).alias("names"),
    )
