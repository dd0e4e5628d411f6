"""Views of the driver's TPC-H-style tables as price panels and feature matrices.

* panel P: ``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part`` with
  Province = region, City = nation, Commodity = part type, Date = order date,
  Price = extended price.
* panel V: ``events`` with City = user, Commodity = event type, Date = ts,
  Price = value (some prices blanked or written as text to exercise cleaning).
* matrix M: ``embeddings`` as an entity x 64-feature matrix with given labels.

Joins are declared, not hinted: at scale lineitem/orders/customer/part are all
large and shuffle-joined on their keys (co-locate them with bucketing when the
tables are written bucketed); nation/region are fixed-size TPC-H dimensions
(25 and 5 rows) and are broadcast by the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel_p(spark: SparkSession, sf_dir: str, with_keys: bool = False) -> DataFrame:
    """Long panel (Province, City, Commodity, Date, Price) over the order lines."""
    t = lambda n: table(spark, sf_dir, n)
    geo = (
        t("nation").select("n_nationkey", "n_name", "n_regionkey")
        .join(t("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    cust = t("customer").select("c_custkey", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    df = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cols = [
        F.col("r_name").alias("Province"),
        F.col("n_name").alias("City"),
        F.col("p_type").alias("Commodity"),
        F.col("o_orderdate").alias("Date"),
        F.col("l_extendedprice").alias("Price"),
    ]
    if with_keys:
        cols += [F.col("l_orderkey"), F.col("l_linenumber")]
    return df.select(*cols)


def write_bucketed_panel(spark: SparkSession, sf_dir: str, base: str, buckets: int | None = None) -> tuple[str, str]:
    """Hand-off of panel P as two tables bucketed and sorted on the order key: orders with their city
    and province, order lines with their item.  The dimensions are attached once, here; every later
    read joins bucket by bucket, without an exchange.  Returns the table names."""
    import uuid

    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = lambda name: table(spark, sf_dir, name)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = t("customer").select("c_custkey", "c_nationkey").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("Date"), F.col("r_name").alias("Province"), F.col("n_name").alias("City"))
    lines = t("lineitem").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("orderkey"), F.col("p_type").alias("Commodity"), F.col("l_extendedprice").alias("Price"))
    names = []
    for name, df in (("orders", orders), ("lines", lines)):
        names.append(f"panel_{name}_{uuid.uuid4().hex}")
        # one task a bucket, so a bucket is one sorted file
        w = df.repartition(n, "orderkey").write.bucketBy(n, "orderkey").sortBy("orderkey").option("path", f"{base.rstrip('/')}/{name}")
        w.format("parquet").saveAsTable(names[-1])
    return names[0], names[1]


def panel_p_bucketed(spark: SparkSession, orders: str, lines: str) -> DataFrame:
    """Panel P from the bucketed hand-off."""
    cols = ("Province", "City", "Commodity", "Date", "Price")
    return spark.table(lines).join(spark.table(orders), "orderkey").select(*cols)


# SQL text of the same view for the DuckDB oracle (tables are pre-registered).
PANEL_P_SQL = """
SELECT r.r_name AS Province, n.n_name AS City, p.p_type AS Commodity,
       o.o_orderdate AS Date, l.l_extendedprice AS Price,
       l.l_orderkey, l.l_linenumber
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
"""


def labels_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster labels for panel P's cities: nation key modulo 4."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("City"), (F.col("n_nationkey") % 4).cast("int").alias("Cluster")
    )


LABELS_P_SQL = "SELECT n_name AS City, CAST(n_nationkey % 4 AS INTEGER) AS Cluster FROM nation"


def coordinates_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates for panel P's cities, derived from the nation key; every
    fifth nation (key % 5 = 4) has none."""
    n = table(spark, sf_dir, "nation")
    return n.where(F.col("n_nationkey") % 5 != 4).select(
        F.col("n_name").alias("City"),
        (F.lit(-10.0) + F.col("n_nationkey") * 0.5).alias("Latitude"),
        (F.lit(95.0) + F.col("n_nationkey") * 1.5).alias("Longitude"),
    )


COORDS_P_SQL = """SELECT n_name AS City, -10.0 + n_nationkey * 0.5 AS Latitude,
       95.0 + n_nationkey * 1.5 AS Longitude FROM nation WHERE n_nationkey % 5 <> 4"""


def panel_v_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a panel whose prices are *text* cells, like a raw sheet:
    thousands commas ('6,550'), null tokens ('-', '', 'NULL'), a padded
    token (' - ') and plain numbers."""
    e = table(spark, sf_dir, "events")
    x = F.round(F.col("value") * 1000).cast("long")
    grouped = F.when(
        x >= 1000, F.concat(F.floor(x / 1000).cast("string"), F.lit(","), F.lpad((x % 1000).cast("string"), 3, "0"))
    ).otherwise(x.cast("string"))
    k = F.col("event_id") % 13
    text = (
        F.when(k == 0, F.lit("-"))
        .when(k == 1, F.lit(""))
        .when(k == 2, F.lit("NULL"))
        .when(k == 3, F.lit(" - "))
        .when(k == 4, x.cast("string"))
        .otherwise(grouped)
    )
    return e.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("City"),
        F.col("event_type").alias("Commodity"),
        F.col("ts").alias("Date"),
        text.alias("Price"),
    )


PANEL_V_TEXT_SQL = """
SELECT event_id, CAST(user_id AS VARCHAR) AS City, event_type AS Commodity, ts AS Date,
  CASE event_id % 13
    WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN 'NULL' WHEN 3 THEN ' - '
    WHEN 4 THEN CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR)
    ELSE CASE WHEN CAST(round(value * 1000) AS BIGINT) >= 1000
      THEN CAST(CAST(floor(CAST(round(value * 1000) AS BIGINT) / 1000) AS BIGINT) AS VARCHAR) || ','
           || lpad(CAST(CAST(round(value * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
      ELSE CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) END
  END AS Price
FROM events
"""


def panel_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a numeric panel (City, Commodity, Date, Price, event_id) with
    every 7th price missing."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("City"),
        F.col("event_type").alias("Commodity"),
        F.col("ts").alias("Date"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("Price"),
    )


PANEL_V_SQL = """
SELECT event_id, CAST(user_id AS VARCHAR) AS City, event_type AS Commodity, ts AS Date,
       CASE WHEN event_id % 7 <> 0 THEN value END AS Price
FROM events
"""


def matrix_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a feature-vector table (entity, features array<double>)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("features"))


def labels_m(spark: SparkSession, sf_dir: str, rule: str = "label") -> DataFrame:
    """Labels for matrix M: the given ``label``, or a derived rule."""
    e = table(spark, sf_dir, "embeddings")
    exprs = {
        "label": F.col("label"),
        "label_mod3": F.col("label") % 3,
        "id_mod4": (F.col("vec_id") % 4).cast("int"),
    }
    return e.select(F.col("vec_id").alias("entity"), exprs[rule].cast("int").alias("cluster"))


LABEL_RULES_SQL = {
    "label": "label",
    "label_mod3": "label % 3",
    "id_mod4": "CAST(vec_id % 4 AS INTEGER)",
}


def long_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix M in long form (entity, feature, value); feature = 'f00'..'f63'."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entity"), F.posexplode("embedding").alias("pos", "v")).select(
        "entity", F.format_string("f%02d", F.col("pos")).alias("feature"), F.col("v").cast("double").alias("value")
    )


LONG_M_SQL = """
SELECT vec_id AS entity, printf('f%02d', i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, range(1, len(embedding) + 1) t(i)
"""
