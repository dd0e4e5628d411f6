"""Panel summaries, data-quality metrics and checks.

Each summary is one aggregate pass (partial + final), plus an exact quantile
pass where a median or IQR is needed.  Checks return *violation rows*
(``step, check, detail``) instead of raising, so a caller can show all of
them or stop at the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.columns import PANEL_REQUIRED, elapsed_days
from ..functions.quantiles import exact_quantiles


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(0))


# ------------------------------------------------------------------ A8
def panel_summary(df: DataFrame, entity="City", item="Commodity", ts="Date", value="Price") -> DataFrame:
    """records, entities, items, date span in whole days, and price
    min / max / mean / median / sample std over non-null prices."""
    a = df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(entity).alias("cities"),
        F.count_distinct(item).alias("commodities"),
        elapsed_days(F.max(ts), F.min(ts)).cast("long").alias("date_range_days"),
        F.min(value).cast("double").alias("price_min"),
        F.max(value).cast("double").alias("price_max"),
        F.avg(value).alias("price_mean"),
        F.stddev_samp(value).alias("price_std"),
    )
    med = exact_quantiles(df, [], value, [0.5], names=["price_median"])
    return _one(a).join(_one(med), "_k").drop("_k")


# ------------------------------------------------------------------ A9
def available_options(df: DataFrame, entity="City", item="Commodity", ts="Date") -> DataFrame:
    """One row: sorted items, years, entities; first / last date; record count.
    Distinct values are reduced map-side before the small final collect."""
    return df.agg(
        F.sort_array(F.collect_set(item)).alias("commodities"),
        F.sort_array(F.collect_set(F.year(ts))).alias("years"),
        F.sort_array(F.collect_set(entity)).alias("cities"),
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("date_start"),
        F.date_format(F.max(ts), "yyyy-MM-dd").alias("date_end"),
        F.count(F.lit(1)).alias("total_records"),
    )


def cities_by_province(df: DataFrame, entity="City", province="Province") -> DataFrame:
    """(Province, sorted distinct cities)."""
    return df.select(province, entity).distinct().groupBy(province).agg(F.sort_array(F.collect_list(entity)).alias("cities"))


# ------------------------------------------------------------------ A10
def _null_cells(df: DataFrame):
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        isnull = c.isNull()
        if isinstance(f.dataType, NumericType) and f.dataType.typeName() in ("double", "float"):
            isnull = isnull | F.isnan(c)
        parts.append(F.count_if(isnull))
    return sum(parts[1:], parts[0])


def data_quality(df: DataFrame, entity="City", item="Commodity", ts="Date", value="Price", iqr_t: float = 1.5) -> DataFrame:
    """One row: missing_data_percentage (over all cells), duplicate_records
    (rows beyond the first per entity/item/date), outlier_percentage (global
    IQR rule on non-null prices, NULL without prices), score =
    clamp(1 - 0.3*missing - 0.2*outliers) and data_completeness."""
    ncols = len(df.columns)
    base = df.agg(
        (_null_cells(df) / (F.count(F.lit(1)) * F.lit(ncols)) * 100).alias("missing_data_percentage"),
        F.count(value).alias("_priced"),
    )
    dups = df.groupBy(entity, item, ts).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_records")
    )
    q = exact_quantiles(df, [], value, [0.25, 0.75], names=["_q1", "_q3"])
    v = F.col(value)
    bounds = q.select(
        (F.col("_q1") - iqr_t * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
        (F.col("_q3") + iqr_t * (F.col("_q3") - F.col("_q1"))).alias("_hi"),
    )
    # the bounds are one row: broadcast (proven size), so the panel is not shuffled
    outl = _one(df.select(value)).join(F.broadcast(_one(bounds)), "_k").agg(
        F.count_if(v.isNotNull() & ((v < F.col("_lo")) | (v > F.col("_hi")))).alias("_out")
    )
    m = _one(base).join(_one(dups), "_k").join(_one(outl), "_k").drop("_k")
    m = m.withColumn("outlier_percentage", F.when(F.col("_priced") > 0, F.col("_out") / F.col("_priced") * 100))
    score = (
        F.lit(1.0)
        - F.col("missing_data_percentage") / 100 * 0.3
        - F.coalesce(F.col("outlier_percentage"), F.lit(0.0)) / 100 * 0.2
    )
    return m.select(
        "missing_data_percentage",
        "duplicate_records",
        "outlier_percentage",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        (1 - F.col("missing_data_percentage") / 100).alias("data_completeness"),
    )


def completeness(df: DataFrame, item="Commodity", value="Price") -> DataFrame:
    """(item, completeness %) = share of non-null prices per item."""
    v = F.col(value)
    miss = v.isNull() | F.isnan(v.cast("double"))
    return df.groupBy(item).agg(((1 - F.count_if(miss) / F.count(F.lit(1))) * 100).alias("completeness"))


def quality_warnings(df: DataFrame, entity="City", item="Commodity", ts="Date", value="Price") -> DataFrame:
    """Warning rows (kind, subject, value) at the original thresholds:
    missing > 50 %, duplicates > 0, outliers > 10 %, item completeness < 50 %."""
    q = data_quality(df, entity, item, ts, value)
    g = q.select(F.explode(F.array(
        F.struct(F.lit("high_missing").alias("kind"), F.lit("all").alias("subject"), F.col("missing_data_percentage").alias("value"),
                 (F.col("missing_data_percentage") > 50).alias("hit")),
        F.struct(F.lit("duplicates").alias("kind"), F.lit("all").alias("subject"), F.col("duplicate_records").cast("double").alias("value"),
                 (F.col("duplicate_records") > 0).alias("hit")),
        F.struct(F.lit("high_outliers").alias("kind"), F.lit("all").alias("subject"), F.col("outlier_percentage").alias("value"),
                 F.coalesce(F.col("outlier_percentage") > 10, F.lit(False)).alias("hit")),
    )).alias("w")).select("w.*")
    c = completeness(df, item, value).select(
        F.lit("low_completeness").alias("kind"), F.col(item).alias("subject"), F.col("completeness").alias("value"),
        (F.col("completeness") < 50).alias("hit"),
    )
    return g.unionByName(c).where("hit").drop("hit")


# ------------------------------------------------------------------ A15, A16
def data_checks(df: DataFrame, min_rows: int = 100, min_days: int = 30, first_only: bool = True,
                entity="City", item="Commodity", ts="Date", value="Price") -> DataFrame:
    """Structure checks in the original order: required columns, numeric
    price, no negative price, at least ``min_rows`` rows, at least
    ``min_days`` days between first and last date.  Returns violation rows
    (step, check, detail); with ``first_only`` only the first failure."""
    spark = df.sparkSession
    schema = "step int, check string, detail string"
    required = [entity, item, ts, value]
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([(1, "required_columns", f"missing: {missing}")], schema)
    if not isinstance(df.schema[value].dataType, NumericType):
        return spark.createDataFrame([(2, "numeric_price", f"{value} is {df.schema[value].dataType.simpleString()}")], schema)
    a = df.agg(
        F.count_if(F.col(value) < 0).alias("_neg"),
        F.count(F.lit(1)).alias("_rows"),
        elapsed_days(F.max(ts), F.min(ts)).cast("long").alias("_days"),
    )
    rows = a.select(F.explode(F.array(
        F.struct(F.lit(3).alias("step"), F.lit("negative_prices").alias("check"),
                 F.format_string("%d negative prices", F.col("_neg")).alias("detail"), (F.col("_neg") > 0).alias("hit")),
        F.struct(F.lit(4).alias("step"), F.lit("min_rows").alias("check"),
                 F.format_string("%d rows < %d", F.col("_rows"), F.lit(min_rows)).alias("detail"), (F.col("_rows") < min_rows).alias("hit")),
        F.struct(F.lit(5).alias("step"), F.lit("min_days").alias("check"),
                 F.format_string("%d days < %d", F.coalesce(F.col("_days"), F.lit(0)), F.lit(min_days)).alias("detail"),
                 (F.coalesce(F.col("_days"), F.lit(0)) < min_days).alias("hit")),
    )).alias("c")).select("c.*").where("hit").drop("hit")
    if first_only:
        rows = rows.agg(F.min_by(F.struct("step", "check", "detail"), "step").alias("f")).where(F.col("f").isNotNull()).select("f.*")
    return rows


def year_checks(df: DataFrame, start_year: int = 2020, end_year: int = 2024, ts="Date") -> DataFrame:
    """Distinct years outside [start_year, end_year]."""
    y = F.year(ts)
    return df.select(y.alias("year")).where(F.col("year").isNotNull() & ~F.col("year").between(start_year, end_year)).distinct()


# ------------------------------------------------------------------ A17
def _row(level, check, detail, hit):
    return F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), detail.alias("detail"), hit.alias("hit"))


def matrix_checks(matrix: DataFrame, k: int | None = None, coords: DataFrame | None = None, entity: str = "City") -> DataFrame:
    """Checks of a wide feature matrix before clustering, as
    (level, check, detail) rows: empty, no feature column, non-numeric
    columns, NULL cells per column, infinities, duplicate entities, fewer
    than 2 entities, entities without coordinates (warning), zero-variance
    features (warning), and k outside [2, n-1] when ``k`` is given."""
    spark = matrix.sparkSession
    schema = "level string, check string, detail string"
    feats = [f.name for f in matrix.schema.fields if f.name != entity and isinstance(f.dataType, NumericType)]
    other = [f.name for f in matrix.schema.fields if f.name != entity and not isinstance(f.dataType, NumericType)]
    static = []
    if not feats:
        static.append(("error", "no_features", "no numeric feature column"))
    if other:
        static.append(("error", "non_numeric", ", ".join(sorted(other))))
    out = spark.createDataFrame(static, schema)
    n = matrix.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("d"))
    rows = [
        F.struct(F.lit("error").alias("level"), F.lit("empty").alias("check"), F.lit("matrix has no rows").alias("detail"), (F.col("n") == 0).alias("hit")),
        _row("error", "duplicate_entities", F.format_string("%d duplicate rows", F.col("n") - F.col("d")), F.col("n") > F.col("d")),
        _row("error", "too_few_entities", F.format_string("%d < 2", F.col("n")), F.col("n") < 2),
    ]
    if k is not None:
        rows.append(_row("error", "k_range", F.format_string("k=%d, n=%d", F.lit(k), F.col("n")),
                         (F.lit(k) < 2) | (F.lit(k) >= F.col("n"))))
    out = out.unionByName(n.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("hit").drop("hit"))
    if feats:
        long = matrix.select(entity, *[F.col(f"`{c}`").cast("double").alias(c) for c in feats]).unpivot(entity, feats, "feature", "value")
        per = long.groupBy("feature").agg(
            F.count_if(F.col("value").isNull() | F.isnan("value")).alias("_null"),
            F.count_if(F.abs(F.col("value")) == F.lit(float("inf"))).alias("_inf"),
            F.var_pop(F.when(~F.isnan("value"), F.col("value"))).alias("_var"),
        )
        out = out.unionByName(per.where(F.col("_null") > 0).select(
            F.lit("error").alias("level"), F.lit("null_values").alias("check"),
            F.format_string("%s: %d", F.col("feature"), F.col("_null")).alias("detail")))
        out = out.unionByName(per.where(F.col("_inf") > 0).select(
            F.lit("error").alias("level"), F.lit("infinite_values").alias("check"),
            F.format_string("%s: %d", F.col("feature"), F.col("_inf")).alias("detail")))
        out = out.unionByName(per.where(F.col("_var") == 0).select(
            F.lit("warning").alias("level"), F.lit("zero_variance").alias("check"), F.col("feature").alias("detail")))
    if coords is not None:
        miss = matrix.select(entity).join(coords.select(entity), entity, "left_anti")
        out = out.unionByName(miss.select(F.lit("warning").alias("level"), F.lit("no_coordinates").alias("check"),
                                          F.col(entity).cast("string").alias("detail")))
    return out


# ------------------------------------------------------------------ A11 - A14
def cluster_sizes(labels: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """(cluster, size)."""
    return labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def cluster_members(labels: DataFrame, entity: str = "City", cluster: str = "Cluster") -> DataFrame:
    """(cluster, count, members = sorted comma-joined entity list)."""
    return labels.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.sort_array(F.collect_list(F.col(entity).cast("string"))), ", ").alias("members"),
    )


def cluster_geo_summary(labels: DataFrame, coords: DataFrame, entity: str = "City", cluster: str = "Cluster") -> DataFrame:
    """Per cluster: members, count, count with coordinates, mean
    latitude / longitude and the north / south / east / west bounds."""
    j = labels.select(entity, cluster).join(coords.select(entity, "Latitude", "Longitude"), entity, "left")
    return j.groupBy(cluster).agg(
        F.sort_array(F.collect_list(F.col(entity).cast("string"))).alias("cities"),
        F.count(F.lit(1)).alias("count"),
        F.count("Latitude").alias("with_coordinates"),
        F.avg("Latitude").alias("center_lat"),
        F.avg("Longitude").alias("center_lon"),
        F.max("Latitude").alias("north"),
        F.min("Latitude").alias("south"),
        F.max("Longitude").alias("east"),
        F.min("Longitude").alias("west"),
    )


HIGHER_IS_BETTER = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True}


def best_config(metrics: DataFrame, metric: str | None = None, order: str = "run") -> DataFrame:
    """Best (algorithm, k) per metric over a metrics table with columns
    algorithm, k, ``order`` (run order) and one column per metric; the
    earliest run wins a tie.  NULL metric values are skipped."""
    names = [metric] if metric else [m for m in HIGHER_IS_BETTER if m in metrics.columns]
    parts = []
    for m in names:
        sign = 1 if HIGHER_IS_BETTER[m] else -1
        key = F.when(F.col(m).isNotNull(), F.struct((F.col(m) * sign).alias("v"), (-F.col(order)).alias("o")))
        parts.append(metrics.agg(F.max_by(F.struct("algorithm", "k", F.col(m).alias("value")), key).alias("b")).select(
            F.lit(m).alias("metric"), "b.algorithm", "b.k", "b.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
