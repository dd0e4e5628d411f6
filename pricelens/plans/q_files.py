"""Registered file queries: data derived from the driver tables by Spark is
written into a fresh folder below the shared checkpoint directory and read
back (S1-S9, D1-D3, P1, P2, Z2, Z3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import evaluate as ev
from ..operators import features as fe
from ..session import scratch_path
from ..sources import panel_io as io_
from ..sources import sheets as sh
from ..sources import tables as tb
from . import fixtures as fx
from .q_eval import _RULES, E, _labelings, _metrics_rows_sql
from .registry import query, r4, r6

P = tb.PANEL_P_SQL
CO = tb.COORDS_P_SQL
CELL_SQL = f"SELECT Province, City, Commodity, Date, round(avg(Price), 2) AS Price FROM ({P}) GROUP BY ALL"


def _cells(spark, sf):
    """One text cell per (city, item, date): the mean price, 2 decimals,
    thousands separators (as in the original sheets)."""
    p = tb.panel_p(spark, sf)
    a = p.groupBy("Province", "City", "Commodity", "Date").agg(r6(F.avg("Price"), 2).alias("v"))
    return a.select("Province", "City", "Commodity", "Date", F.format_number("v", 2).alias("cell"))


def _sheet_tree(spark, sf, fmt="xlsx"):
    root = scratch_path(spark, "sheets")
    fx.write_sheets(_cells(spark, sf), root, fmt).count()
    return root


def _zip_tree(spark, sf):
    root = scratch_path(spark, "zips")
    fx.write_zips(_cells(spark, sf), root).count()
    return root


def _panel_from_cells(cells):
    d = sh.cells_to_panel(cells)
    d = cl.cast_price(cl.replace_null_tokens(d))
    return d.where(F.col("Price").isNotNull())


@query("s1_scan_sheets", f"SELECT Province, City, Commodity, Date, Price FROM ({CELL_SQL})")
def s1(spark, sf):
    cells, _ = sh.scan_sheets(spark, _sheet_tree(spark, sf))
    return _panel_from_cells(cells).select("Province", "City", "Commodity", "Date", "Price")


@query("s1_scan_sheets_csv", f"SELECT City, Commodity, count(*) AS n, round(sum(Price), 2) AS total FROM ({CELL_SQL}) GROUP BY ALL")
def s1c(spark, sf):
    cells, _ = sh.scan_sheets(spark, _sheet_tree(spark, sf, "csv"), extensions=["csv"])
    p = _panel_from_cells(cells)
    return p.groupBy("City", "Commodity").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("Price"), 2).alias("total"))


@query("s2_scan_zip", f"SELECT Province, City, Commodity, Date, Price FROM ({CELL_SQL})")
def s2(spark, sf):
    cells, _ = sh.scan_zip(spark, _zip_tree(spark, sf))
    return _panel_from_cells(cells).select("Province", "City", "Commodity", "Date", "Price")


@query("p1_melt_sheet", f"""
SELECT Commodity, City, 'PANEL' AS Source_File, CAST(y AS VARCHAR) AS Date, CAST(total AS VARCHAR) AS Price
FROM (SELECT City, Commodity, year(Date) AS y, round(sum(Price), 2) AS total FROM ({P}) GROUP BY ALL)""")
def p1(spark, sf):
    p = tb.panel_p(spark, sf).withColumn("y", F.year("Date").cast("string"))
    years = sorted(r[0] for r in p.select("y").distinct().collect())
    wide = p.groupBy("City", F.col("Commodity").alias("Komoditas (Rp)")).pivot("y", years).agg(r6(F.sum("Price"), 2))
    wide = wide.withColumn("No", F.lit(1))
    long = sh.melt_sheet(wide, meta={"Source_File": "PANEL"}, ids=["City"])
    return long.where(F.col("Price").isNotNull())


@query("p2_parse_dates", f"""
SELECT h AS header, CAST(CASE WHEN ok THEN d END AS TIMESTAMP) AS Date FROM (
  SELECT strftime(Date, '%d/ %m/ %Y') AS h, Date AS d, true AS ok FROM (SELECT DISTINCT Date FROM ({P}))
  UNION ALL SELECT strftime(Date, '%d/%m/%Y'), Date, false FROM (SELECT DISTINCT Date FROM ({P}))
  UNION ALL SELECT 'Total', NULL, false)""")
def p2(spark, sf):
    from ..functions.columns import parse_header_date

    p = tb.panel_p(spark, sf).select("Date").distinct()
    heads = p.select(F.date_format("Date", "dd/ MM/ yyyy").alias("h")).unionByName(
        p.select(F.date_format("Date", "dd/MM/yyyy").alias("h"))).unionByName(spark.range(1).select(F.lit("Total").alias("h")))
    return heads.select(F.col("h").alias("header"), parse_header_date("h").alias("Date"))


@query("s3_read_panel", f"SELECT City, Commodity, Date, Price FROM ({P})")
def s3(spark, sf):
    out = scratch_path(spark, "export")
    io_.export_panel(tb.panel_p(spark, sf), out)
    return io_.read_panel(spark, f"{out}/panel.csv").select("City", "Commodity", "Date", "Price")


# Every fifth price with thousands commas, every seventh a word, every eleventh date unreadable.
@query("s3_read_panel_bad_values", f"""
WITH p AS (SELECT City, Commodity, Date, Price, l_orderkey * 8 + l_linenumber AS k FROM ({P})),
x AS (SELECT City, Commodity, CASE WHEN k % 11 = 0 THEN NULL ELSE Date END AS Date, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL ELSE Price END AS Price FROM p)
SELECT 'csv' AS format, * FROM x UNION ALL SELECT 'parquet', * FROM x""")
def s3_bad(spark, sf):
    """The same panel of text cells as CSV and as Parquet: unreadable values become NULL."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    price = F.when(k % 5 == 0, F.lit("1,234.5")).when(k % 7 == 0, F.lit("none")).otherwise(F.col("Price").cast("string"))
    date = F.when(k % 11 == 0, F.lit("31/31/1996")).otherwise(F.date_format("Date", "yyyy-MM-dd HH:mm:ss"))
    p = tb.panel_p(spark, sf, with_keys=True).select("City", "Commodity", date.alias("Date"), price.alias("Price"))
    out, back = scratch_path(spark, "bad"), None
    p.write.option("header", "true").csv(f"{out}/panel.csv")
    p.write.parquet(f"{out}/panel.parquet")
    for fmt in ("csv", "parquet"):
        one = io_.read_panel(spark, f"{out}/panel.{fmt}").select(F.lit(fmt).alias("format"), "City", "Commodity", F.col("Date").cast("timestamp_ntz").alias("Date"), "Price")
        back = one if back is None else back.unionByName(one)
    return back


@query("s4_read_latest", f"SELECT City, Commodity, Date, Price FROM ({P})")
def s4(spark, sf):
    """The newer of two whole exports, each a folder of part files; the older has doubled prices."""
    import time

    base, p = scratch_path(spark, "latest"), tb.panel_p(spark, sf)
    p.withColumn("Price", F.col("Price") * 2).write.option("header", "true").csv(f"{base}/panel_z.csv")
    time.sleep(1.1)  # a modification time of its own
    p.write.option("header", "true").csv(f"{base}/panel_a.csv")
    return io_.read_latest(spark, base, "panel_*.csv").select("City", "Commodity", "Date", "Price")


@query("s5_read_coordinates", CO)
def s5(spark, sf):
    path = scratch_path(spark, "coords")
    c = tb.coordinates_p(spark, sf)
    one = c.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("City", F.array("Latitude", "Longitude"))))).alias("value"))
    one.coalesce(1).write.text(path)
    return io_.read_coordinates(spark, path)


@query("s6_panel_roundtrip", f"""
SELECT strftime(Date, '%Y') AS Year, count(*) AS n, round(sum(Price), 2) AS total FROM ({P}) GROUP BY 1""")
def s6(spark, sf):
    base = scratch_path(spark, "handoff")
    p = cl.add_year_month(tb.panel_p(spark, sf))
    io_.write_panel(p, base, "run1")
    back = io_.load_panel(spark, base, "run1")
    return back.groupBy("Year").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("Price"), 2).alias("total"))


@query("s7_export_metadata", f"""
SELECT count(*) AS total_rows, count(DISTINCT City) AS cities, count(DISTINCT Commodity) AS commodities,
       strftime(min(Date), '%Y-%m-%d') AS date_min, strftime(max(Date), '%Y-%m-%d') AS date_max,
       list_sort(list_distinct(list(City))) AS city_list, list_sort(list_distinct(list(Commodity))) AS commodity_list
FROM ({P})""")
def s7(spark, sf):
    out = scratch_path(spark, "export")
    paths = io_.export_panel(tb.panel_p(spark, sf), out)
    m = spark.read.json(paths["metadata"])
    return m.select("total_rows", "cities", "commodities", "date_min", "date_max", "city_list", "commodity_list")


@query("s8_export_features", f"""
WITH fx AS ({{FX}})
SELECT count(*) AS cells, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
       round(min(value), 4) AS min, round(max(value), 4) AS max, 18 AS columns FROM fx""".replace("{FX}", __import__(
    "pricelens.plans.q_features", fromlist=["FX_P_SQL"]).FX_P_SQL))
def s8(spark, sf):
    out = scratch_path(spark, "features")
    m = fe.feature_matrix(tb.panel_p(spark, sf), ("avg", "cv", "trend"))
    paths = io_.export_features(m, None, out)
    meta = spark.read.json(paths["features_metadata"])
    return meta.select("cells", r4("mean").alias("mean"), r4("std").alias("std"), r4("min").alias("min"), r4("max").alias("max"),
                       "columns")


@query("s9_export_run", f"""
WITH m AS (SELECT * FROM {_metrics_rows_sql()}),
z AS (SELECT run, cluster, count(*) AS size FROM ({" UNION ALL ".join(
    f"SELECT {i} AS run, cluster FROM {E.format(rule=rule)}" for i, rule in enumerate(_RULES.values()))}) GROUP BY ALL)
SELECT m.run, m.algorithm, m.k, m.silhouette, m.davies_bouldin, m.calinski_harabasz, 0.5 * (m.run + 1) AS execution_time, z.cluster, z.size
FROM m JOIN z USING (run)""")
def s9(spark, sf):
    """Three labelings exported as runs and read back: time, metrics and sizes per run."""
    m = tb.matrix_m(spark, sf)
    runs, labels = None, None
    pairs = ev.pair_metrics(m, _labelings(spark, sf), again=True)  # one walk for all
    for i, rule in enumerate(_RULES):
        lb = tb.labels_m(spark, sf, rule)
        one = ev.evaluate(m, lb, rule, pairs=pairs.get(i, {})).select(F.lit(i).alias("run"), F.lit(rule).alias("algorithm"), F.lit(lb.select("cluster").distinct().count()).alias("k"),
                                              F.lit(0.5 * (i + 1)).alias("execution_time"), "*")
        who = lb.select(F.lit(i).alias("run"), "entity", "cluster")
        runs, labels = (one, who) if runs is None else (runs.unionByName(one), labels.unionByName(who))
    paths = io_.export_runs(runs, labels, scratch_path(spark, "run"))
    back = spark.read.json(paths["runs"]).select("run", "execution_time", F.explode("cluster_sizes").alias("z")).select(
        "run", "execution_time", F.col("z.cluster").cast("int").alias("cluster"), "z.size")
    summary = spark.read.option("header", "true").option("inferSchema", "true").csv(paths["summary"])
    j = summary.drop("execution_time").join(back, "run")
    return j.select(F.col("run").cast("int").alias("run"), "algorithm", F.col("k").cast("long").alias("k"), *[r4(c).alias(c) for c in ev.CORE],
                    "execution_time", "cluster", "size")


@query("s6_bucketed_panel", f"""
SELECT Province, City, Commodity, strftime(Date, '%Y') AS Year, count(*) AS n, round(sum(Price), 2) AS total, round(min(Price), 2) AS least FROM ({P}) GROUP BY ALL""")
def s6b(spark, sf):
    """Panel P joined bucket by bucket from its hand-off on the order key."""
    names = tb.write_bucketed_panel(spark, sf, scratch_path(spark, "bucketed"))
    p = cl.add_year_month(tb.panel_p_bucketed(spark, *names))
    return p.groupBy("Province", "City", "Commodity", "Year").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("Price"), 2).alias("total"), r6(F.min("Price"), 2).alias("least"))


@query("d1_available_data", f"""
SELECT list_sort(list_distinct(list(Province))) AS provinces, list_sort(list_distinct(list(CAST(year(Date) AS INTEGER)))) AS years
FROM ({P})""")
def d1(spark, sf):
    cells, _ = sh.scan_sheets(spark, _sheet_tree(spark, sf))
    return sh.available_data(cells)


@query("d2_file_catalog", f"""
SELECT DISTINCT City, Province, '1996.xlsx' AS filename, [1996] AS years_in_file, 1996 AS year FROM ({P}) WHERE year(Date) = 1996""")
def d2(spark, sf):
    cells, _ = sh.scan_sheets(spark, _sheet_tree(spark, sf))
    cat = sh.file_catalog(cells, years=[1996])
    return cat.select("City", "Province", "filename", "years_in_file", "year")


@query("d3_check_layout", f"""
WITH f AS (SELECT DISTINCT 'data/' || Province || '/' || City || '/' || CAST(year(Date) AS VARCHAR) || CASE WHEN n_nationkey % 8 = 0 THEN '.xls' ELSE '.xlsx' END AS subject,
             City, n_nationkey % 8 AS k FROM ({P}) JOIN nation ON n_name = City)
SELECT subject, 'unknown_city' AS "check", City AS detail FROM f WHERE k <> 0 AND City NOT IN (SELECT City FROM ({CO}))
UNION ALL SELECT subject, 'layout', 'expected [ROOT/]PROVINCE/CITY/YYYY.xlsx' FROM f WHERE k = 0
UNION ALL SELECT subject, 'unreadable', 'ValueError: unsupported file type: ' || substr(subject, 6) FROM f WHERE k = 0
UNION ALL SELECT subject, 'unreadable', 'BadZipFile: File is not a zip file' FROM f WHERE k = 1
UNION ALL SELECT subject, 'unparseable_dates', 'date headers without the blank after ' || chr(39) || '/' || chr(39) FROM f WHERE k = 2
UNION ALL SELECT subject, 'no_date_columns', 'no DD/ MM/ YYYY header' FROM f WHERE k = 3
UNION ALL SELECT subject, 'no_numeric_data', 'no numeric price cell' FROM f WHERE k = 3 OR k = 4
UNION ALL SELECT subject, 'empty_item_column', 'item column is empty' FROM f WHERE k = 5""")
def d3(spark, sf):
    """Archives with one of six faults planted in most cities' sheets, and cities not in the list."""
    nation = tb.table(spark, sf, "nation")
    faults = F.array(*[F.lit(f) for f in fx.FAULTS])
    wrong = nation.select(F.col("n_name").alias("City"), F.get(faults, F.col("n_nationkey") % 8).alias("fault"))
    root = scratch_path(spark, "faults")
    fx.write_zips(_cells(spark, sf).join(wrong, "City"), root, fault="fault").count()
    found = sh.scan(spark, root, archives=True)
    return sh.check_layout(found.members, found.cells, found.failed, tb.coordinates_p(spark, sf).select("City"))


# Each sheet has every date and item of its city and year; the gaps are filled inside the sheet.
_FILLED_SQL = f"""
WITH c AS (SELECT *, year(Date) AS y FROM ({CELL_SQL})),
g AS (SELECT * FROM (SELECT DISTINCT Province, City, y, Date FROM c) JOIN (SELECT DISTINCT Province, City, y, Commodity FROM c) USING (Province, City, y)),
x AS (SELECT g.*, c.Price AS raw FROM g LEFT JOIN c USING (Province, City, y, Commodity, Date)),
filled AS (SELECT City, Commodity, Date, coalesce(
    last_value(raw IGNORE NULLS) OVER (PARTITION BY Province, City, y, Commodity ORDER BY Date),
    first_value(raw IGNORE NULLS) OVER (PARTITION BY Province, City, y, Commodity ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS Price FROM x)"""


@query("z2_build_panel", f"""
{_FILLED_SQL}
SELECT count(*) AS records, count(DISTINCT City) AS cities, count(DISTINCT Commodity) AS commodities,
       date_diff('day', min(Date), max(Date)) AS date_range_days, round(min(Price), 4) AS price_min, round(max(Price), 4) AS price_max,
       round(avg(Price), 4) AS price_mean, round(quantile_cont(Price, 0.5), 4) AS price_median, round(stddev_samp(Price), 4) AS price_std
FROM filled""")
def z2(spark, sf):
    """Sheets -> long -> per-file cleaning -> one panel; its summary."""
    from .pipelines import build_panel

    panel, catalog, failed, summary = build_panel(spark, _sheet_tree(spark, sf), items=None)
    prices = ("price_min", "price_max", "price_mean", "price_median", "price_std")
    return summary.select("records", "cities", "commodities", "date_range_days", *[r4(c).alias(c) for c in prices])


@query("z2_panel_rows", f"""
{_FILLED_SQL}
SELECT City, Commodity, Date, round(Price, 4) AS Price FROM filled""")
def z2r(spark, sf):
    """Every row of the panel built from the sheets, gaps filled."""
    from .pipelines import build_panel

    panel, _, _, _ = build_panel(spark, _sheet_tree(spark, sf), items=None)
    return panel.select("City", "Commodity", F.col("Date").cast("timestamp_ntz").alias("Date"), r4("Price").alias("Price"))


@query("z3_validate_panel", f"""
SELECT DISTINCT 'data/' || Province || '/' || City || '/' || CAST(year(Date) AS VARCHAR) || '.xlsx' AS subject,
       'unknown_city' AS "check", City AS detail FROM ({P}) WHERE City NOT IN (SELECT City FROM ({CO}))
UNION ALL SELECT DISTINCT City, 'unknown_city', 'not a supported city' FROM ({P}) WHERE City NOT IN (SELECT City FROM ({CO}))
UNION ALL SELECT DISTINCT Commodity, 'unknown_commodity', 'not a supported commodity' FROM ({P})""")
def z3(spark, sf):
    """Layout + content checks of an archive upload: every violation."""
    from .pipelines import validate_panel

    _, violations, _ = validate_panel(spark, _zip_tree(spark, sf), tb.coordinates_p(spark, sf).select("City"))
    return violations.select("subject", "check", "detail")
