"""Registered panel queries: parsing, filters, fills, summaries, checks,
joins and set operations (P3-P5, F1-F6, W1, W2, Z1, A8-A13, A15-A17, J1-J5,
U1, U2, O1, O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import features as fe
from ..operators import joins as jn
from ..operators import setops as so
from ..operators import summary as sm
from ..sources import tables as tb
from .registry import query, r4, r6

P = tb.PANEL_P_SQL
V = tb.PANEL_V_SQL
VT = tb.PANEL_V_TEXT_SQL
LB = tb.LABELS_P_SQL
CO = tb.COORDS_P_SQL
TOKENS = "('-', '', 'nan', 'NaN', 'null', 'NULL')"
NUM_RE = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
PRICE_SQL = f"""CASE WHEN regexp_full_match(trim(replace(Price, ',', '')), '{NUM_RE}')
  THEN CASE WHEN isnan(TRY_CAST(trim(replace(Price, ',', '')) AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(trim(replace(Price, ',', '')) AS DOUBLE) END END"""
KEYS = ["l_orderkey", "l_linenumber"]


def _p(spark, sf):
    return tb.panel_p(spark, sf, with_keys=True)


# ---------------------------------------------------------------- filters
@query("f1_filter_items", f"""
SELECT l_orderkey, l_linenumber, City, Commodity, Price FROM ({P}) WHERE Commodity IN ('PROMO', 'STANDARD')""")
def f1(spark, sf):
    return cl.filter_items(_p(spark, sf), ["PROMO", "STANDARD"]).select(*KEYS, "City", "Commodity", "Price")


@query("f2_filter_panel", f"""
SELECT l_orderkey, l_linenumber, City, Commodity, Date, Price FROM ({P})
WHERE year(Date) IN (1996, 1997, 1999) AND City IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND Commodity IN ('PROMO', 'SMALL', 'LARGE')""")
def f2(spark, sf):
    d = cl.filter_panel(_p(spark, sf), years=[1996, 1997, 1999], cities=["NATION_1", "NATION_2", "NATION_3"],
                        items=["PROMO", "SMALL", "LARGE"])
    return d.select(*KEYS, "City", "Commodity", "Date", "Price")


@query("f3_filter_date_range", f"""
SELECT l_orderkey, l_linenumber, Date FROM ({P})
WHERE Date IS NOT NULL AND Date >= TIMESTAMP '1996-01-01' AND Date <= TIMESTAMP '1998-12-31'""")
def f3(spark, sf):
    return cl.filter_date_range(_p(spark, sf), 1996, 1998).select(*KEYS, "Date")


@query("f4_drop_outliers_iqr", f"""
WITH b AS (SELECT Commodity, quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.75) AS q3 FROM ({P}) GROUP BY Commodity)
SELECT l_orderkey, l_linenumber, Commodity, Price FROM ({P}) p JOIN b USING (Commodity)
WHERE Price IS NULL OR (Price >= q1 - 1.0 * (q3 - q1) AND Price <= q3 + 1.0 * (q3 - q1))""")
def f4(spark, sf):
    return cl.drop_outliers_iqr(_p(spark, sf), threshold=1.0).select(*KEYS, "Commodity", "Price")


@query("f5_drop_outliers_zscore", f"""
WITH s AS (SELECT Commodity, avg(Price) AS mu, stddev_samp(Price) AS sd FROM ({P}) GROUP BY Commodity)
SELECT l_orderkey, l_linenumber, Commodity, Price FROM ({P}) p JOIN s USING (Commodity)
WHERE Price IS NULL OR sd IS NULL OR sd = 0 OR abs((Price - mu) / sd) <= 2.0""")
def f5(spark, sf):
    return cl.drop_outliers_zscore(_p(spark, sf), threshold=2.0).select(*KEYS, "Commodity", "Price")


@query("f6_drop_null_keys", f"SELECT event_id, City, Date, Price FROM ({V}) WHERE Date IS NOT NULL AND Price IS NOT NULL")
def f6(spark, sf):
    return cl.drop_null_keys(tb.panel_v(spark, sf), ["Date", "Price"]).select("event_id", "City", "Date", "Price")


# ---------------------------------------------------------------- parsing
@query("p3_null_tokens", f"SELECT event_id, CASE WHEN Price IN {TOKENS} THEN NULL ELSE Price END AS Price FROM ({VT})")
def p3(spark, sf):
    return cl.replace_null_tokens(tb.panel_v_text(spark, sf)).select("event_id", "Price")


@query("p4_parse_price", f"""
SELECT event_id, {PRICE_SQL} AS Price
FROM (SELECT event_id, CASE WHEN Price IN {TOKENS} THEN NULL ELSE Price END AS Price FROM ({VT}))""")
def p4(spark, sf):
    return cl.cast_price(cl.replace_null_tokens(tb.panel_v_text(spark, sf))).select("event_id", "Price")


@query("p5_add_period", f"""
SELECT strftime(Date, '%Y-%m') AS Period, strftime(Date, '%Y') AS Year, count(*) AS n FROM ({P}) GROUP BY 1, 2""")
def p5(spark, sf):
    d = cl.add_period(_p(spark, sf), "M")
    d = cl.add_period(d, "Y", name="Year")
    return d.groupBy("Period", "Year").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- fills
_FILL = """coalesce(
  last_value({v} IGNORE NULLS) OVER (PARTITION BY City, Commodity ORDER BY Date, event_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({v} IGNORE NULLS) OVER (PARTITION BY City, Commodity ORDER BY Date, event_id
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w1_fill_gaps", f"SELECT event_id, {_FILL.format(v='Price')} AS Price FROM ({V})")
def w1(spark, sf):
    return cl.fill_gaps(tb.panel_v(spark, sf), order=["Date", "event_id"]).select("event_id", "Price")


@query("w1_fill_gaps_text", f"""
SELECT event_id, {_FILL.format(v='Price')} AS Price
FROM (SELECT event_id, City, Commodity, Date, CASE WHEN Price IN {TOKENS} THEN NULL ELSE Price END AS Price FROM ({VT}))""")
def w1t(spark, sf):
    d = cl.replace_null_tokens(tb.panel_v_text(spark, sf))
    return cl.fill_gaps(d, order=["Date", "event_id"]).select("event_id", "Price")


@query("w2_group_minmax", f"""
WITH a AS (SELECT City, Commodity, avg(Price) AS value FROM ({P}) GROUP BY City, Commodity)
SELECT City, Commodity, round(value, 4) AS value,
       round(min(value) OVER (PARTITION BY Commodity), 4) AS group_min,
       round(max(value) OVER (PARTITION BY Commodity), 4) AS group_max FROM a""")
def w2(spark, sf):
    a = tb.panel_p(spark, sf).groupBy("City", "Commodity").agg(F.avg("Price").alias("value"))
    g = cl.group_minmax(a, "Commodity", "value")
    return g.select("City", "Commodity", *[r4(c).alias(c) for c in ("value", "group_min", "group_max")])


_Z1_FILLED = f"""(SELECT event_id, City, Commodity, Date, {_FILL.format(v='Price')} AS Price
  FROM (SELECT event_id, City, Commodity, Date, CASE WHEN Price IN {TOKENS} THEN NULL ELSE Price END AS Price FROM ({VT})))"""


@query("z1_clean_panel", f"""
SELECT event_id, City, Commodity, Date, {PRICE_SQL} AS Price FROM {_Z1_FILLED}
WHERE Commodity IN ('click', 'view', 'purchase', 'signup')""")
def z1(spark, sf):
    from .pipelines import clean_panel

    d = clean_panel(tb.panel_v_text(spark, sf), items=["click", "view", "purchase", "signup"], order=["Date", "event_id"])
    return d.select("event_id", "City", "Commodity", "Date", "Price")


@query("z1_clean_panel_outliers", f"""
WITH c AS (SELECT event_id, City, Commodity, Date, {PRICE_SQL} AS Price FROM {_Z1_FILLED}
           WHERE Commodity IN ('click', 'view', 'purchase', 'signup')),
b AS (SELECT Commodity, quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.75) AS q3 FROM c GROUP BY Commodity)
SELECT event_id, Price FROM c JOIN b USING (Commodity)
WHERE Price IS NULL OR (Price >= q1 - 1.5 * (q3 - q1) AND Price <= q3 + 1.5 * (q3 - q1))""")
def z1o(spark, sf):
    from .pipelines import clean_panel

    d = clean_panel(tb.panel_v_text(spark, sf), items=["click", "view", "purchase", "signup"], order=["Date", "event_id"],
                    outliers="iqr")
    return d.select("event_id", "Price")


# ---------------------------------------------------------------- summaries
@query("a8_panel_summary", f"""
SELECT count(*) AS records, count(DISTINCT City) AS cities, count(DISTINCT Commodity) AS commodities,
  CAST(floor(date_diff('microsecond', min(Date), max(Date)) / 86400000000.0) AS BIGINT) AS date_range_days,
  round(min(Price), 4) AS price_min, round(max(Price), 4) AS price_max, round(avg(Price), 4) AS price_mean,
  round(stddev_samp(Price), 4) AS price_std, round(quantile_cont(Price, 0.5), 4) AS price_median
FROM ({P})""")
def a8(spark, sf):
    s = sm.panel_summary(tb.panel_p(spark, sf))
    return s.select("records", "cities", "commodities", "date_range_days",
                    *[r4(c).alias(c) for c in ("price_min", "price_max", "price_mean", "price_std", "price_median")])


@query("a9_available_options", f"""
SELECT list_sort(list_distinct(list(Commodity))) AS commodities,
       list_sort(list_distinct(list(CAST(year(Date) AS INTEGER)))) AS years,
       list_sort(list_distinct(list(City))) AS cities,
       strftime(min(Date), '%Y-%m-%d') AS date_start, strftime(max(Date), '%Y-%m-%d') AS date_end,
       count(*) AS total_records FROM ({P})""")
def a9(spark, sf):
    return sm.available_options(tb.panel_p(spark, sf))


@query("a9_cities_by_province", f"""
SELECT Province, list_sort(list(DISTINCT City)) AS cities FROM ({P}) GROUP BY Province""")
def a9b(spark, sf):
    return sm.cities_by_province(tb.panel_p(spark, sf))


_V_CELLS = "(count(*) - count(event_id)) + (count(*) - count(City)) + (count(*) - count(Commodity)) + (count(*) - count(Date)) + (count(*) - count(Price))"


@query("a10_data_quality", f"""
WITH v AS ({V}),
b AS (SELECT quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.75) AS q3 FROM v),
m AS (SELECT ({_V_CELLS}) * 100.0 / (count(*) * 5) AS missing, count(Price) AS priced FROM v),
d AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS dups FROM (SELECT count(*) AS c FROM v GROUP BY City, Commodity, Date)),
o AS (SELECT count(*) FILTER (WHERE Price < q1 - 1.5 * (q3 - q1) OR Price > q3 + 1.5 * (q3 - q1)) AS out FROM v, b)
SELECT round(missing, 6) AS missing_data_percentage, dups AS duplicate_records,
  round(CASE WHEN priced > 0 THEN out * 100.0 / priced END, 6) AS outlier_percentage,
  round(greatest(0.0, least(1.0, 1.0 - missing / 100 * 0.3 - coalesce(CASE WHEN priced > 0 THEN out * 100.0 / priced END, 0) / 100 * 0.2)), 6) AS score,
  round(1 - missing / 100, 6) AS data_completeness
FROM m, d, o""")
def a10(spark, sf):
    q = sm.data_quality(tb.panel_v(spark, sf))
    return q.select(*[r6(c).alias(c) if c != "duplicate_records" else F.col(c) for c in q.columns])


@query("a10_completeness", f"""
SELECT Commodity, round((1 - count(*) FILTER (WHERE Price IS NULL) / count(*)) * 100, 6) AS completeness
FROM ({V}) GROUP BY Commodity""")
def a10c(spark, sf):
    c = sm.completeness(tb.panel_v(spark, sf))
    return c.withColumn("completeness", r6("completeness"))


@query("a10_quality_warnings", f"""
WITH v AS (SELECT City, Commodity, Date, CASE WHEN Price > 40 THEN NULL ELSE Price END AS Price, event_id FROM ({V})),
d AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS dups FROM (SELECT count(*) AS c FROM v GROUP BY City, Commodity, Date)),
c AS (SELECT Commodity, (1 - count(*) FILTER (WHERE Price IS NULL) / count(*)) * 100 AS completeness FROM v GROUP BY Commodity)
SELECT 'duplicates' AS kind, 'all' AS subject, CAST(dups AS DOUBLE) AS value FROM d WHERE dups > 0
UNION ALL SELECT 'low_completeness', Commodity, round(completeness, 6) FROM c WHERE completeness < 50""")
def a10w(spark, sf):
    v = tb.panel_v(spark, sf).withColumn("Price", F.when(F.col("Price") <= 40, F.col("Price")))
    w = sm.quality_warnings(v)
    return w.withColumn("value", F.when(F.col("kind") == "duplicates", F.col("value")).otherwise(r6("value")))


@query("a15_data_checks", f"""
SELECT 5 AS step, 'min_days' AS "check",
       printf('%d days < %d', CAST(floor(date_diff('microsecond', min(Date), max(Date)) / 86400000000.0) AS BIGINT), 30) AS detail
FROM ({V}) HAVING count(*) FILTER (WHERE Price < 0) = 0 AND count(*) >= 100
   AND floor(date_diff('microsecond', min(Date), max(Date)) / 86400000000.0) < 30""")
def a15(spark, sf):
    return sm.data_checks(tb.panel_v(spark, sf))


@query("a15_data_checks_all", f"""
WITH a AS (SELECT count(*) FILTER (WHERE Price < 0) AS neg, count(*) AS n,
                  CAST(floor(date_diff('microsecond', min(Date), max(Date)) / 86400000000.0) AS BIGINT) AS days
           FROM (SELECT City, Commodity, Date, Price - 50 AS Price FROM ({V})))
SELECT 3 AS step, 'negative_prices' AS "check", printf('%d negative prices', neg) AS detail FROM a WHERE neg > 0
UNION ALL SELECT 4, 'min_rows', printf('%d rows < %d', n, 100) FROM a WHERE n < 100
UNION ALL SELECT 5, 'min_days', printf('%d days < %d', days, 30) FROM a WHERE days < 30""")
def a15all(spark, sf):
    v = tb.panel_v(spark, sf).withColumn("Price", F.col("Price") - 50)
    return sm.data_checks(v, first_only=False)


@query("a16_year_checks", f"SELECT DISTINCT CAST(year(Date) AS INTEGER) AS year FROM ({P}) WHERE year(Date) NOT BETWEEN 1996 AND 1999")
def a16(spark, sf):
    return sm.year_checks(tb.panel_p(spark, sf), 1996, 1999)


@query("a17_matrix_checks", f"""
WITH fx AS (SELECT City, Commodity || '_avg' AS feature,
                   CASE WHEN count(*) >= 14 THEN avg(Price) END AS value
            FROM ({V}) GROUP BY City, Commodity),
per AS (SELECT feature, count(*) FILTER (WHERE value IS NULL) AS nulls FROM
          (SELECT c.City, i.feature, fx.value FROM (SELECT DISTINCT City FROM ({V})) c
             CROSS JOIN (SELECT DISTINCT Commodity || '_avg' AS feature FROM ({V})) i
             LEFT JOIN fx USING (City, feature)) GROUP BY feature)
SELECT 'error' AS level, 'null_values' AS "check", printf('%s: %d', feature, nulls) AS detail FROM per WHERE nulls > 0
UNION ALL SELECT 'error', 'k_range', printf('k=%d, n=%d', 200, (SELECT count(DISTINCT City) FROM ({V})))
  WHERE 200 >= (SELECT count(DISTINCT City) FROM ({V}))""")
def a17(spark, sf):
    m = fe.feature_matrix(tb.panel_v(spark, sf), ("avg",), min_points=14)
    return sm.matrix_checks(m, k=200)


# ---------------------------------------------------------------- clusters
@query("a11_cluster_sizes", f"SELECT Cluster, count(*) AS size FROM ({LB}) GROUP BY Cluster")
def a11(spark, sf):
    return sm.cluster_sizes(tb.labels_p(spark, sf))


@query("a12_cluster_members", f"""
SELECT Cluster, count(*) AS count, array_to_string(list_sort(list(City)), ', ') AS members FROM ({LB}) GROUP BY Cluster""")
def a12(spark, sf):
    return sm.cluster_members(tb.labels_p(spark, sf))


@query("a13_cluster_geo_summary", f"""
SELECT Cluster, list_sort(list(City)) AS cities, count(*) AS count, count(Latitude) AS with_coordinates,
  round(avg(Latitude), 6) AS center_lat, round(avg(Longitude), 6) AS center_lon,
  max(Latitude) AS north, min(Latitude) AS south, max(Longitude) AS east, min(Longitude) AS west
FROM ({LB}) l LEFT JOIN ({CO}) c USING (City) GROUP BY Cluster""")
def a13(spark, sf):
    g = sm.cluster_geo_summary(tb.labels_p(spark, sf), tb.coordinates_p(spark, sf))
    return g.withColumn("center_lat", r6("center_lat")).withColumn("center_lon", r6("center_lon"))


# ---------------------------------------------------------------- joins
@query("j1_attach_clusters", f"""
SELECT Cluster, Commodity, count(*) AS n, round(avg(Price), 4) AS avg_price
FROM ({P}) p LEFT JOIN (SELECT * FROM ({LB}) WHERE City <> 'NATION_7') l USING (City) GROUP BY Cluster, Commodity""")
def j1(spark, sf):
    lb = tb.labels_p(spark, sf).where(F.col("City") != "NATION_7")
    j = jn.attach_clusters(tb.panel_p(spark, sf), lb)
    return j.groupBy("Cluster", "Commodity").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("Price")).alias("avg_price"))


@query("j2_attach_coordinates", f"SELECT DISTINCT City, Latitude, Longitude FROM (SELECT DISTINCT City FROM ({P})) LEFT JOIN ({CO}) USING (City)")
def j2(spark, sf):
    return jn.attach_coordinates(tb.panel_p(spark, sf).select("City").distinct(), tb.coordinates_p(spark, sf))


@query("j3_map_points", f"SELECT DISTINCT City, Cluster, Latitude, Longitude FROM ({LB}) JOIN ({CO}) USING (City)")
def j3(spark, sf):
    return jn.map_points(tb.labels_p(spark, sf), tb.coordinates_p(spark, sf))


@query("j4_unknown_keys", f"SELECT DISTINCT City FROM ({P}) WHERE City NOT IN (SELECT City FROM ({CO}))")
def j4(spark, sf):
    return jn.unknown_keys(tb.panel_p(spark, sf), tb.coordinates_p(spark, sf).select("City"), "City")


@query("j5_dense_grid", f"""
WITH f AS (SELECT Commodity, Cluster, CAST(year(Date) AS INTEGER) AS Year, avg(Price) AS avg_price
           FROM ({P}) JOIN ({LB}) USING (City) WHERE year(Date) <> 1998 OR Cluster <> 2 GROUP BY ALL),
pairs AS (SELECT DISTINCT Commodity, Cluster FROM f),
years AS (SELECT DISTINCT CAST(year(Date) AS INTEGER) AS Year FROM ({P}))
SELECT pairs.Commodity, pairs.Cluster, years.Year, round(f.avg_price, 4) AS avg_price
FROM pairs CROSS JOIN years LEFT JOIN f USING (Commodity, Cluster, Year)""")
def j5(spark, sf):
    p = jn.attach_clusters(tb.panel_p(spark, sf), tb.labels_p(spark, sf)).withColumn("Year", F.year("Date"))
    p = p.where((F.col("Year") != 1998) | (F.col("Cluster") != 2))
    facts = p.groupBy("Commodity", "Cluster", "Year").agg(r4(F.avg("Price")).alias("avg_price"))
    years = [r[0] for r in tb.panel_p(spark, sf).select(F.year("Date")).distinct().collect()]
    base = facts.select("Commodity", "Cluster").distinct()
    return jn.dense_grid(facts, base, {"Year": sorted(years)}, ["Commodity", "Cluster", "Year"])


# ---------------------------------------------------------------- set ops
@query("u1_consolidate", f"""
SELECT Province, Commodity, count(*) AS n FROM (
  SELECT Province, City, Commodity, Date, Price FROM ({P})
  UNION ALL BY NAME SELECT City, Commodity, Date, Price FROM ({V})) GROUP BY Province, Commodity""")
def u1(spark, sf):
    a = tb.panel_p(spark, sf)
    b = tb.panel_v(spark, sf).select("City", "Commodity", "Date", "Price")
    return so.consolidate([a, b]).groupBy("Province", "Commodity").agg(F.count(F.lit(1)).alias("n"))


@query("u2_distinct_pairs", f"SELECT DISTINCT Province, City FROM ({P})")
def u2(spark, sf):
    return so.distinct_pairs(tb.panel_p(spark, sf), "Province", "City")


@query("o1_sort_desc", f"""
SELECT City, round(avg_price, 4) AS avg_price, row_number() OVER (ORDER BY avg_price DESC NULLS LAST, City) AS rank
FROM (SELECT City, avg(Price) AS avg_price FROM ({V}) GROUP BY City)""")
def o1(spark, sf):
    a = tb.panel_v(spark, sf).groupBy("City").agg(F.avg("Price").alias("avg_price"))
    return so.sort_desc(a, "avg_price", ["City"]).withColumn("avg_price", r4("avg_price"))


@query("o2_top_n", f"SELECT DISTINCT Commodity FROM ({V}) ORDER BY Commodity LIMIT 3")
def o2(spark, sf):
    return so.top_n(tb.panel_v(spark, sf), "Commodity", 3)
