"""Registered report queries on panel P with the nation-based labels
(R1-R8, R10, R11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as rp
from ..sources import tables as tb
from .registry import query, r4, r6

P = tb.PANEL_P_SQL
LB = tb.LABELS_P_SQL
CO = tb.COORDS_P_SQL
PL = f"(SELECT p.*, l.Cluster FROM ({P}) p LEFT JOIN ({LB}) l USING (City))"


def _pl(spark, sf):
    return tb.panel_p(spark, sf), tb.labels_p(spark, sf)


@query("r1_monthly_trends", f"""
WITH d AS (SELECT *, CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month FROM {PL}
           WHERE Cluster IS NOT NULL AND Commodity IN ('PROMO', 'SMALL', 'ECONOMY') AND year(Date) IN (1996, 1997)),
f AS (SELECT Commodity, Cluster, Year, Month, avg(Price) AS avg_price FROM d GROUP BY ALL),
g AS (SELECT DISTINCT Commodity, Cluster FROM d)
SELECT g.Commodity, g.Cluster, y.Year, m.Month, round(f.avg_price, 4) AS avg_price
FROM g CROSS JOIN (VALUES (1996), (1997)) y(Year) CROSS JOIN range(1, 13) m(Month)
LEFT JOIN f ON f.Commodity = g.Commodity AND f.Cluster = g.Cluster AND f.Year = y.Year AND f.Month = m.Month""")
def r1(spark, sf):
    p, lb = _pl(spark, sf)
    t = rp.monthly_trends(p, lb, items=["PROMO", "SMALL", "ECONOMY"], years=[1996, 1997])
    return t.select("Commodity", "Cluster", "Year", F.col("Month").cast("long").alias("Month"), r4("avg_price").alias("avg_price"))


@query("r2_monthly_trends_sparse", f"""
WITH d AS (SELECT * FROM {PL} WHERE Date IS NOT NULL AND Price IS NOT NULL AND Cluster IS NOT NULL)
SELECT Commodity, Cluster, date_trunc('month', Date) AS Month, round(avg(Price), 4) AS avg_price
FROM d GROUP BY ALL""")
def r2(spark, sf):
    p, lb = _pl(spark, sf)
    t = rp.monthly_trends_sparse(p, lb)
    return t.select("Commodity", "Cluster", "Month", r4("avg_price").alias("avg_price"))


@query("r3_radar_profile", f"""
WITH a AS (SELECT Cluster, Commodity, avg(Price) AS m FROM {PL} WHERE Cluster IS NOT NULL GROUP BY ALL),
i AS (SELECT Commodity, min(m) AS lo, max(m) AS hi, count(m) AS nc FROM a GROUP BY Commodity),
g AS (SELECT c.Cluster, i.Commodity FROM (SELECT DISTINCT Cluster FROM a) c CROSS JOIN i)
SELECT g.Cluster, g.Commodity, round(CASE WHEN a.m IS NULL THEN NULL WHEN i.nc <= 1 OR i.hi <= i.lo THEN 0.5
       ELSE (a.m - i.lo) / (i.hi - i.lo) END, 6) AS value
FROM g JOIN i USING (Commodity) LEFT JOIN a USING (Cluster, Commodity)""")
def r3(spark, sf):
    p, lb = _pl(spark, sf)
    return rp.radar_profile(p, lb, digits=None).withColumn("value", r6("value"))


_BOX_SQL = f"""
WITH d AS (SELECT *, CAST(year(Date) AS INTEGER) AS Year FROM {PL} WHERE Cluster IS NOT NULL),
s AS (SELECT Commodity, Year, Cluster, min(Price) AS min, quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.5) AS median,
             quantile_cont(Price, 0.75) AS q3, max(Price) AS max, avg(Price) AS mean, stddev_pop(Price) AS std FROM d GROUP BY ALL),
g AS (SELECT i.Commodity, y.Year, c.Cluster FROM (SELECT DISTINCT Commodity FROM d) i, (SELECT DISTINCT Year FROM d) y,
             (SELECT DISTINCT Cluster FROM d) c)"""


@query("r4_boxplot_stats", _BOX_SQL + """
SELECT g.Commodity, g.Year, g.Cluster, round(min, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(max, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std
FROM g LEFT JOIN s USING (Commodity, Year, Cluster)""")
def r4q(spark, sf):
    p, lb = _pl(spark, sf)
    stats, _ = rp.boxplot_stats(p, lb)
    return stats.select("Commodity", "Year", "Cluster", *[r4(c).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean", "std")])


# Correlations on the events panel: (user, day) rows, event types as items.
VD = """(SELECT CAST(user_id AS VARCHAR) AS City, event_type AS Commodity, date_trunc('day', ts) AS Date, value AS Price,
         CAST(user_id % 3 AS INTEGER) AS Cluster FROM events)"""


def _vd(spark, sf):
    e = tb.table(spark, sf, "events")
    d = e.select(F.col("user_id").cast("string").alias("City"), F.col("event_type").alias("Commodity"),
                 F.date_trunc("day", "ts").alias("Date"), F.col("value").alias("Price"))
    lb = e.select(F.col("user_id").cast("string").alias("City"), (F.col("user_id") % 3).cast("int").alias("Cluster")).distinct()
    return d, lb


@query("r4_boxplot_outliers", f"""
WITH d AS (SELECT City, Commodity, CAST(year(Date) AS INTEGER) AS Year, Cluster, Price FROM {VD}),
s AS (SELECT Commodity, Year, Cluster, quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.75) AS q3 FROM d GROUP BY ALL)
SELECT d.Commodity, d.Year, d.Cluster, d.Price AS value FROM d JOIN s USING (Commodity, Year, Cluster)
WHERE d.Price < s.q1 - 1.5 * (s.q3 - s.q1) OR d.Price > s.q3 + 1.5 * (s.q3 - s.q1)""")
def r4o(spark, sf):
    d, lb = _vd(spark, sf)
    _, outl = rp.boxplot_stats(d, lb)
    return outl


def _corr_sql(cluster: bool) -> str:
    ck = "Cluster, " if cluster else ""
    return f"""
WITH g AS (SELECT {ck}City, Date, Commodity, avg(Price) AS x FROM {VD} WHERE Price IS NOT NULL GROUP BY ALL),
r AS (SELECT {ck.replace('Cluster', 'a.Cluster')}a.Commodity AS item_a, b.Commodity AS item_b,
             covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS r, count(*) AS n
      FROM g a JOIN g b ON a.City = b.City AND a.Date = b.Date {'AND a.Cluster = b.Cluster' if cluster else ''} GROUP BY ALL),
i AS (SELECT DISTINCT Commodity FROM {VD}),
base AS ({'SELECT Cluster, count(*) AS rows_ FROM (SELECT DISTINCT Cluster, City, Date FROM ' + VD + ') GROUP BY Cluster' if cluster else 'SELECT 1 AS one'}),
grid AS (SELECT {'base.Cluster, base.rows_, ' if cluster else ''}ia.Commodity AS item_a, ib.Commodity AS item_b FROM base, i ia, i ib)
SELECT {'grid.Cluster, ' if cluster else ''}grid.item_a, grid.item_b,
       round({'CASE WHEN grid.rows_ < 3 THEN NULL ELSE r.r END' if cluster else 'r.r'}, 6) AS r, coalesce(r.n, 0) AS n
FROM grid LEFT JOIN r ON {'r.Cluster = grid.Cluster AND ' if cluster else ''}r.item_a = grid.item_a AND r.item_b = grid.item_b"""


@query("r5_correlation_global", _corr_sql(False))
def r5(spark, sf):
    d, _ = _vd(spark, sf)
    c = rp.correlation(d, pvalues=False)
    return c.select("item_a", "item_b", r6("r").alias("r"), "n")


@query("r6_correlation_per_cluster", _corr_sql(True))
def r6q(spark, sf):
    d, lb = _vd(spark, sf)
    c = rp.correlation(d, lb, pvalues=False)
    return c.select("Cluster", "item_a", "item_b", r6("r").alias("r"), "n")


@query("r6_correlation_small_clusters", _corr_sql(True).replace("user_id % 3", "user_id % 97").replace("rows_ < 3", "rows_ < 45"))
def r6s(spark, sf):
    """Many clusters, of which those with fewer than 45 (city, date) rows have no correlation."""
    d, _ = _vd(spark, sf)
    e = tb.table(spark, sf, "events").select("user_id").distinct()
    lb = e.select(F.col("user_id").cast("string").alias("City"), (F.col("user_id") % 97).cast("int").alias("Cluster"))
    return rp.correlation(d, lb, min_rows=45, pvalues=False).select("Cluster", "item_a", "item_b", r6("r").alias("r"), "n")


# Two-sided p of Student's t by its finite trigonometric sums (theta = atan(t / sqrt(df))):
# even df: 1 - sin * sum c_i cos^2i; odd df: 1 - 2/pi (theta + sin * sum e_i cos^(2i-1)).
@query("r7_correlation_pvalues", f"""
WITH c AS ({_corr_sql(False).replace("round(r.r, 6) AS r", "r.r AS r")}),
t AS (SELECT *, n - 2 AS df, least(abs(r), 1.0) AS s, sqrt(greatest(1 - r * r, 0.0)) AS co FROM c),
terms AS (SELECT item_a, item_b, sum(CASE
    WHEN df % 2 = 0 THEN CASE WHEN i < df // 2 THEN exp(lgamma(i + 0.5) - lgamma(i + 1.0) + 2 * i * ln(co)) / sqrt(pi()) ELSE 0 END
    ELSE CASE WHEN i >= 1 AND i <= df // 2 THEN sqrt(pi()) / 2 * exp(lgamma(i * 1.0) - lgamma(i + 0.5) + (2 * i - 1) * ln(co)) ELSE 0 END END) AS total
  FROM t, range((SELECT max(df) // 2 + 1 FROM t)) g(i) WHERE item_a <> item_b AND co > 0 AND df >= 1 GROUP BY item_a, item_b)
SELECT t.item_a, t.item_b, round(t.r, 6) AS r, t.n, round(CASE WHEN t.item_a = t.item_b THEN 1.0 WHEN t.r IS NULL OR t.df < 1 THEN NULL
    WHEN co = 0 THEN 0.0 WHEN t.df % 2 = 0 THEN 1 - s * total ELSE 1 - 2 / pi() * (asin(s) + s * total) END, 6) AS p
FROM t LEFT JOIN terms USING (item_a, item_b)""")
def r7(spark, sf):
    d, _ = _vd(spark, sf)
    c = rp.correlation(d)
    return c.select("item_a", "item_b", r6("r").alias("r"), "n", r6("p").alias("p"))


# The two leading eigenvectors of the covariance in SQL: the matrix is squared
# (and scaled) until only the leading direction is left, then deflated.
def _leading_sql(cov: str, out: str) -> str:
    """CTEs ``{out}`` (v list of loadings, signed; l eigenvalue) of ``cov`` (one row, m list of lists)."""
    return f"""
{out}_p AS (SELECT 0 AS it, m FROM {cov} UNION ALL
  SELECT it + 1, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q) / list_sum(list_transform(m, lambda z: list_dot_product(z, z)))))
  FROM {out}_p WHERE it < 24),
{out}_c AS (SELECT list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d, m FROM {out}_p WHERE it = 24),
{out}_u AS (SELECT m[list_position(d, list_max(d))] AS u FROM {out}_c),
{out}_n AS (SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS v FROM {out}_u),
{out}_s AS (SELECT CASE WHEN -list_min(v) > list_max(v) THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM {out}_n),
{out} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {out}_s, {cov})"""


_PCA_SQL = f"""
WITH RECURSIVE lf AS (SELECT vec_id AS entity, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mu AS (SELECT i, avg(x) AS mu FROM lf GROUP BY i),
ce AS (SELECT entity, i, x - mu AS x FROM lf JOIN mu USING (i)),
cv AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM ce a JOIN ce b USING (entity) GROUP BY ALL),
cr AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i),
c1 AS (SELECT list(r ORDER BY i) AS m FROM cr),{_leading_sql("c1", "e1")},
c2 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM c1, e1),
{_leading_sql("c2", "e2").strip()},
rows_ AS (SELECT entity, list(x ORDER BY i) AS f FROM ce GROUP BY entity)"""


@query("r8_project_2d", _PCA_SQL + """
SELECT r.entity, CAST(b.label AS INTEGER) AS cluster, round(list_dot_product(f, e1.v), 4) AS pc1, round(list_dot_product(f, e2.v), 4) AS pc2
FROM rows_ r JOIN embeddings b ON b.vec_id = r.entity, e1, e2""")
def r8(spark, sf):
    """PCA projection of matrix M."""
    pts, _, _ = rp.project_2d(tb.matrix_m(spark, sf), tb.labels_m(spark, sf))
    return pts.select("entity", "cluster", r4("pc1").alias("pc1"), r4("pc2").alias("pc2"))


@query("r8_project_2d_variance", _PCA_SQL + """,
t AS (SELECT sum(c) AS total FROM cv WHERE i = j)
SELECT 'pc1' AS component, round(e1.l, 6) AS explained_variance, round(e1.l / total, 6) AS explained_variance_ratio FROM e1, t
UNION ALL SELECT 'pc2', round(e2.l, 6), round(e2.l / total, 6) FROM e2, t""")
def r8v(spark, sf):
    _, _, var = rp.project_2d(tb.matrix_m(spark, sf), tb.labels_m(spark, sf))
    return var.select("component", r6("explained_variance").alias("explained_variance"), r6("explained_variance_ratio").alias("explained_variance_ratio"))


@query("r10_assignments", f"""
SELECT City AS name, Latitude AS lat, Longitude AS lon, Cluster AS clusterId FROM ({LB}) LEFT JOIN ({CO}) USING (City)""")
def r10(spark, sf):
    return rp.assignments(tb.labels_p(spark, sf), tb.coordinates_p(spark, sf))
