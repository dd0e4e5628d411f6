"""Registered feature / scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import scale as sc
from ..sources import tables as tb
from .registry import query, r4, r6

P = tb.PANEL_P_SQL
V = tb.PANEL_V_SQL


def _days_sql(panel: str, keys: str) -> str:
    """Panel rows with _days = whole days since the first priced row of the group."""
    return f"""(SELECT p.*, floor(date_diff('microsecond', t0.t0, p.Date) / 86400000000.0) AS _days
       FROM ({panel}) p LEFT JOIN (SELECT {keys}, min(Date) AS t0 FROM ({panel}) q
                             WHERE Price IS NOT NULL GROUP BY {keys}) t0 USING ({keys}))"""


@query("a1_feature_avg", f"""
SELECT City, Commodity, round(avg(Price), 4) AS avg FROM ({P}) GROUP BY City, Commodity""")
def a1(spark, sf):
    p = tb.panel_p(spark, sf)
    return p.groupBy("City", "Commodity").agg(r4(fe.feature_avg()).alias("avg"))


@query("a2_feature_cv", f"""
SELECT City, Commodity, round(CASE WHEN count(Price) >= 2 AND avg(Price) <> 0
   THEN stddev_samp(Price) / avg(Price) END, 6) AS cv
FROM ({V}) GROUP BY City, Commodity""")
def a2(spark, sf):
    v = tb.panel_v(spark, sf)
    return v.groupBy("City", "Commodity").agg(r6(fe.feature_cv()).alias("cv"))


@query("a3_feature_trend_ols", f"""
SELECT City, Commodity, round(CASE WHEN regr_count(Price, _days) < 3 THEN NULL
   WHEN regr_sxx(Price, _days) = 0 THEN 0.0 ELSE regr_slope(Price, _days) END, 6) AS trend
FROM {_days_sql(V, 'City, Commodity')} GROUP BY City, Commodity""")
def a3(spark, sf):
    return fe.feature_trend(tb.panel_v(spark, sf), ["City", "Commodity"]).withColumn("trend", r6("trend"))


@query("a4_feature_trend_simple", f"""
SELECT City, Commodity,
  round(CASE WHEN count(Price) < 3 OR max(CASE WHEN Price IS NOT NULL THEN _days END)
                                      = min(CASE WHEN Price IS NOT NULL THEN _days END) THEN NULL
   ELSE (arg_max(Price, struct_pack(d := Date, p := Price)) FILTER (WHERE Price IS NOT NULL)
         - arg_min(Price, struct_pack(d := Date, p := Price)) FILTER (WHERE Price IS NOT NULL))
        / (max(CASE WHEN Price IS NOT NULL THEN _days END) - min(CASE WHEN Price IS NOT NULL THEN _days END)) END, 6) AS trend
FROM {_days_sql(V, 'City, Commodity')} GROUP BY City, Commodity""")
def a4(spark, sf):
    return fe.feature_trend(tb.panel_v(spark, sf), ["City", "Commodity"], method="simple_slope").withColumn("trend", r6("trend"))


# The items of the two panels and the order years.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ORDER_YEARS = tuple(range(1995, 2002))


def _static_pivot(names, value: str) -> str:
    """Columns of a wide matrix from rows (feature, value)."""
    return ", ".join(f"max(CASE WHEN feature = '{n}' THEN {value} END) AS \"{n}\"" for n in names)


_A5_SQL = f"""
WITH g AS (
  SELECT City, Commodity, count(*) AS n, avg(Price) AS a,
         CASE WHEN count(Price) >= 2 AND avg(Price) <> 0 THEN stddev_samp(Price) / avg(Price) END AS c,
         CASE WHEN regr_count(Price, _days) < 3 THEN NULL WHEN regr_sxx(Price, _days) = 0 THEN 0.0
              ELSE regr_slope(Price, _days) END AS t
  FROM {_days_sql(V, 'City, Commodity')} GROUP BY City, Commodity),
grid AS (SELECT c.City, i.Commodity FROM (SELECT DISTINCT City FROM ({V})) c,
                                         (SELECT DISTINCT Commodity FROM ({V})) i),
l AS (
  SELECT grid.City, grid.Commodity || '_' || f.name AS feature,
         CASE WHEN g.n >= 10 THEN CASE f.name WHEN 'avg' THEN g.a WHEN 'cv' THEN g.c ELSE g.t END END AS value
  FROM grid LEFT JOIN g USING (City, Commodity), (VALUES ('avg'), ('cv'), ('trend')) f(name))
SELECT City, {_static_pivot([f"{i}_{f}" for i in EVENT_TYPES for f in ("avg", "cv", "trend")], "round(value, 4)")} FROM l GROUP BY City
"""


@query("a5_feature_matrix_all", _A5_SQL)
def a5(spark, sf):
    v = tb.panel_v(spark, sf)
    m = fe.feature_matrix(v, features=("avg", "cv", "trend"), freq="all", min_points=10)
    return m.select("City", *[r4(c).alias(c) for c in m.columns if c != "City"])


_A6_SQL = f"""
WITH d AS (SELECT *, strftime(Date, '%Y') AS period FROM ({P})),
g AS (SELECT City, Commodity, period, count(*) AS n, avg(Price) AS a,
        CASE WHEN count(Price) >= 2 AND avg(Price) <> 0 THEN stddev_samp(Price) / avg(Price) END AS c
      FROM d GROUP BY ALL),
grid AS (SELECT c.City, i.Commodity, y.period FROM (SELECT DISTINCT City FROM d) c,
           (SELECT DISTINCT Commodity FROM d) i, (SELECT DISTINCT period FROM d) y),
l AS (SELECT grid.City, grid.Commodity || '_' || f.name || '_' || grid.period AS feature,
         CASE WHEN g.n >= 10 THEN CASE f.name WHEN 'avg' THEN g.a ELSE g.c END END AS value
      FROM grid LEFT JOIN g USING (City, Commodity, period), (VALUES ('avg'), ('cv')) f(name))
SELECT City, {_static_pivot([f"{i}_{f}_{y}" for i in PART_TYPES for f in ("avg", "cv") for y in ORDER_YEARS], "round(value, 4)")} FROM l GROUP BY City
"""


@query("a6_feature_matrix_yearly", _A6_SQL)
def a6(spark, sf):
    p = tb.panel_p(spark, sf)
    m = fe.feature_matrix(p, features=("avg", "cv"), freq="Y", min_points=10)
    return m.select("City", *[r4(c).alias(c) for c in m.columns if c != "City"])


@query("a6_feature_matrix_monthly_long", f"""
WITH d AS (SELECT *, strftime(Date, '%Y-%m') AS period FROM ({V})),
g AS (SELECT City, Commodity, period, count(*) AS n, avg(Price) AS a FROM d GROUP BY ALL),
grid AS (SELECT c.City, i.Commodity, y.period FROM (SELECT DISTINCT City FROM d) c,
           (SELECT DISTINCT Commodity FROM d) i, (SELECT DISTINCT period FROM d) y)
SELECT grid.City, grid.Commodity, grid.period, 'avg' AS type,
       grid.Commodity || '_avg_' || grid.period AS feature,
       round(CASE WHEN g.n >= 3 THEN g.a END, 6) AS value
FROM grid LEFT JOIN g USING (City, Commodity, period)""")
def a6m(spark, sf):
    v = tb.panel_v(spark, sf)
    m = fe.feature_matrix(v, features=("avg",), freq="M", min_points=3, wide=False)
    return m.withColumn("value", r6("value"))


_PM = f"SELECT *, strftime(Date, '%Y-%m') AS period FROM ({P})"
_FX_MONTHLY_SQL = f"""
WITH d AS MATERIALIZED ({_PM}),
g AS (SELECT City, Commodity, period, count(*) AS n, avg(Price) AS a,
         CASE WHEN count(Price) >= 2 AND avg(Price) <> 0 THEN stddev_samp(Price) / avg(Price) END AS c,
         CASE WHEN regr_count(Price, x) < 3 THEN NULL WHEN regr_sxx(Price, x) = 0 THEN 0.0 ELSE regr_slope(Price, x) END AS t
      FROM (SELECT d.*, floor(date_diff('microsecond', min(Date) FILTER (Price IS NOT NULL) OVER (PARTITION BY City, Commodity, period), Date) / 86400000000.0) AS x FROM d)
      GROUP BY City, Commodity, period),
grid AS (SELECT c.City, i.Commodity, y.period FROM (SELECT DISTINCT City FROM d) c,
           (SELECT DISTINCT Commodity FROM d) i, (SELECT DISTINCT period FROM d) y)
SELECT City, Commodity, period, f.name AS type, Commodity || '_' || f.name || '_' || period AS feature,
       CASE WHEN g.n >= 3 THEN CASE f.name WHEN 'avg' THEN g.a WHEN 'cv' THEN g.c ELSE g.t END END AS value
FROM grid LEFT JOIN g USING (City, Commodity, period), (VALUES ('avg'), ('cv'), ('trend')) f(name)"""


@query("a6_feature_matrix_monthly_all", f"SELECT * REPLACE (round(value, 4) AS value) FROM ({_FX_MONTHLY_SQL})")
def a6m_all(spark, sf):
    """Every feature of every month (some 1500 columns) of panel P, long."""
    m = fe.feature_matrix(tb.panel_p(spark, sf), features=("avg", "cv", "trend"), freq="M", min_points=3, wide=False)
    return m.withColumn("value", r4("value"))


@query("p6_to_vector_monthly", f"""
SELECT City, list(coalesce(round(value, 4), -1e9) ORDER BY Commodity, type, period) AS features, list(feature ORDER BY Commodity, type, period) AS names
FROM ({_FX_MONTHLY_SQL}) GROUP BY City""")
def p6m(spark, sf):
    v = fe.matrix_vector(tb.panel_p(spark, sf), ("avg", "cv", "trend"), freq="M", min_points=3)
    return v.select("City", F.transform("features", lambda x: F.coalesce(r4(x), F.lit(-1e9))).alias("features"), "names")


def _fx_p(spark, sf):
    """Long feature matrix of panel P (avg, cv, trend)."""
    return fe.feature_matrix(tb.panel_p(spark, sf), features=("avg", "cv", "trend"), wide=False)


_FX_P_SQL = f"""
WITH g AS (
  SELECT City, Commodity, count(*) AS n, avg(Price) AS a,
         CASE WHEN count(Price) >= 2 AND avg(Price) <> 0 THEN stddev_samp(Price) / avg(Price) END AS c,
         CASE WHEN regr_count(Price, _days) < 3 THEN NULL WHEN regr_sxx(Price, _days) = 0 THEN 0.0
              ELSE regr_slope(Price, _days) END AS t
  FROM {_days_sql(P, 'City, Commodity')} GROUP BY City, Commodity),
grid AS (SELECT c.City, i.Commodity FROM (SELECT DISTINCT City FROM ({P})) c,
                                         (SELECT DISTINCT Commodity FROM ({P})) i)
SELECT grid.City, grid.Commodity, 'all' AS period, f.name AS type, grid.Commodity || '_' || f.name AS feature,
       CASE WHEN g.n >= 10 THEN CASE f.name WHEN 'avg' THEN g.a WHEN 'cv' THEN g.c ELSE g.t END END AS value
FROM grid LEFT JOIN g USING (City, Commodity), (VALUES ('avg'), ('cv'), ('trend')) f(name)
"""
FX_P_SQL = _FX_P_SQL


def _scaled_sql(center: str, scale: str) -> str:
    return f"""
WITH fx AS ({_FX_P_SQL}),
s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
      FROM fx GROUP BY feature)
SELECT fx.City, fx.feature, round((fx.value - {center}) /
       CASE WHEN ({scale}) IS NULL OR ({scale}) = 0 THEN 1.0 ELSE ({scale}) END, 6) AS value
FROM fx JOIN s USING (feature)"""


@query("x1_scale_standard", _scaled_sql("s.mean", "s.std"))
def x1(spark, sf):
    out, _ = sc.scale(_fx_p(spark, sf), "standard")
    return out.select("City", "feature", r6("value").alias("value"))


@query("x2_scale_minmax", _scaled_sql("s.mn", "s.mx - s.mn"))
def x2(spark, sf):
    out, _ = sc.scale(_fx_p(spark, sf), "minmax")
    return out.select("City", "feature", r6("value").alias("value"))


@query("x3_scale_robust", _scaled_sql("s.med", "s.q3 - s.q1"))
def x3(spark, sf):
    out, _ = sc.scale(_fx_p(spark, sf), "robust")
    return out.select("City", "feature", r6("value").alias("value"))


@query("x4_scale_all_params", f"""
WITH fx AS ({_FX_P_SQL}),
s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
      FROM fx GROUP BY feature)
SELECT feature, m.method,
  round(CASE m.method WHEN 'standard' THEN mean WHEN 'minmax' THEN mn ELSE med END, 4) AS center,
  round(CASE WHEN (CASE m.method WHEN 'standard' THEN std WHEN 'minmax' THEN mx - mn ELSE q3 - q1 END) IS NULL
        OR (CASE m.method WHEN 'standard' THEN std WHEN 'minmax' THEN mx - mn ELSE q3 - q1 END) = 0 THEN 1.0
        ELSE (CASE m.method WHEN 'standard' THEN std WHEN 'minmax' THEN mx - mn ELSE q3 - q1 END) END, 4) AS scale
FROM s, (VALUES ('standard'), ('minmax'), ('robust')) m(method)""")
def x4(spark, sf):
    _, params = sc.scale_all(_fx_p(spark, sf), ("standard", "minmax", "robust"))
    return params.select("feature", "method", r4("center").alias("center"), r4("scale").alias("scale"))


@query("a7_feature_report", f"""
WITH fx AS ({_FX_P_SQL}),
pe AS (SELECT City, count(*) FILTER (WHERE value IS NULL) AS nn FROM fx GROUP BY City),
cols AS (SELECT feature, type, count(*) FILTER (WHERE value IS NULL) AS miss, count(*) AS rows_, avg(value) AS mean,
                stddev_samp(value) AS std, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.5) AS med
         FROM fx GROUP BY feature, type),
m AS (SELECT count(*)::DOUBLE AS entities, (SELECT count(DISTINCT feature) FROM fx)::DOUBLE AS features,
             sum(nn)::DOUBLE AS missing_total, count(*) FILTER (WHERE nn = 0)::DOUBLE AS complete_rows,
             count(*) FILTER (WHERE nn > 0)::DOUBLE AS incomplete_rows FROM pe),
t AS (SELECT type, count(*)::DOUBLE AS count, min(mn) AS min, max(mx) AS max, avg(mean) AS mean,
             quantile_cont(med, 0.5) AS median, avg(std) AS std, sum(miss) / sum(rows_) AS missing_rate
      FROM cols GROUP BY type)
SELECT 'matrix' AS scope, 'all' AS name, metric, round(value, 4) AS value
FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN (entities, features, missing_total, complete_rows, incomplete_rows))
UNION ALL SELECT 'column', feature, 'missing', miss::DOUBLE FROM cols
UNION ALL SELECT 'type', type, metric, round(value, 4)
FROM t UNPIVOT INCLUDE NULLS (value FOR metric IN (count, min, max, mean, median, std, missing_rate))""")
def a7(spark, sf):
    rep = fe.feature_report(_fx_p(spark, sf))
    return rep.withColumn("value", r4("value"))


@query("p6_to_vector", f"""
WITH fx AS ({_FX_P_SQL})
SELECT City, list(round(value, 4) ORDER BY feature) AS features, list(feature ORDER BY feature) AS names
FROM fx GROUP BY City""")
def p6(spark, sf):
    m = fe.feature_matrix(tb.panel_p(spark, sf), ("avg", "cv", "trend"))
    v = fe.to_vector(m)
    return v.select("City", F.transform("features", lambda x: r4(x)).alias("features"), "names")


@query("z4_build_features", f"""
SELECT City, {_static_pivot([f"{i}_{f}" for i in PART_TYPES for f in ("avg", "cv", "trend")], "value")}
FROM ({_scaled_sql("s.med", "s.q3 - s.q1")}) GROUP BY City""")
def z4(spark, sf):
    from .pipelines import build_features

    _, scaled, _, _ = build_features(tb.panel_p(spark, sf), features=("avg", "cv", "trend"), report=False)
    return scaled.select("City", *[r6(c).alias(c) for c in scaled.columns if c != "City"])
