"""Long-panel files and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_price


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV (header) or Parquet by extension; Date -> timestamp and Price
    -> double, unreadable values -> NULL; any other extension is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = spark.read.option("header", "true").csv(path)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported panel format: {path}")
    cols = {}
    if "Date" in df.columns:
        cols["Date"] = F.coalesce(F.try_to_timestamp(F.col("Date").cast("string")), F.col("Date").cast("string").try_cast("timestamp"))
    if "Price" in df.columns:
        cols["Price"] = parse_price("Price", commas=False)
    if "Month" in df.columns:
        cols["Month"] = F.col("Month").try_cast("int")
    return df.withColumns(cols)


def read_latest(spark: SparkSession, directory: str, glob: str = "*.csv") -> DataFrame:
    """The newest export matching ``glob`` (by modification time): a file, or a folder of part
    files, which is as new as its newest part and read whole.  Only paths and modification times are
    listed; contents are not read."""
    base = directory.rstrip("/")
    listed = None
    for pattern in (f"{base}/{glob}", f"{base}/{glob}/part-*"):
        try:
            one = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        listed = one if listed is None else listed.unionByName(one)
    if listed is None:
        raise FileNotFoundError(f"no file matching {glob} in {directory}")
    parent = F.regexp_extract("path", r"^(.*)/part-[^/]*$", 1)
    export = F.when(parent != "", parent).otherwise(F.col("path"))
    times = listed.groupBy(export.alias("path")).agg(F.max("modificationTime").alias("t"))
    return read_panel(spark, times.agg(F.max_by("path", F.struct("t", "path"))).first()[0])


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """JSON object ``{city: [lat, lon]}`` -> (City, Latitude, Longitude)."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return m.select(F.explode("m").alias("City", "ll")).select("City", F.col("ll")[0].alias("Latitude"), F.col("ll")[1].alias("Longitude"))


def write_panel(df: DataFrame, base: str, panel_id: str, partition_by: Sequence[str] = ("Year",)) -> str:
    """Parquet hand-off keyed by id (partitioned so year filters prune)."""
    path = f"{base.rstrip('/')}/panel_{panel_id}.parquet"
    w = df.write.mode("overwrite")
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)
    return path


def load_panel(spark: SparkSession, base: str, panel_id: str) -> DataFrame:
    """Load a hand-off by id; an unknown id is an error."""
    path = f"{base.rstrip('/')}/panel_{panel_id}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise KeyError(f"unknown panel id {panel_id!r}") from e
    # partition values come back typed by inference; Year is text in the panel
    return df.withColumn("Year", F.col("Year").cast("string")) if "Year" in df.columns else df


def panel_metadata(df: DataFrame, entity="City", item="Commodity", ts="Date") -> DataFrame:
    """Metadata row of an exported panel: counts, date span, sorted lists."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(entity).alias("cities"),
        F.count_distinct(item).alias("commodities"),
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(ts), "yyyy-MM-dd").alias("date_max"),
        F.sort_array(F.collect_set(entity)).alias("city_list"),
        F.sort_array(F.collect_set(item)).alias("commodity_list"),
    )


def export_panel(df: DataFrame, out_dir: str) -> dict[str, str]:
    """Panel as CSV (header) plus a one-row JSON metadata file."""
    base = out_dir.rstrip("/")
    df.write.mode("overwrite").option("header", "true").csv(f"{base}/panel.csv")
    panel_metadata(df).coalesce(1).write.mode("overwrite").json(f"{base}/panel_metadata.json")
    return {"csv": f"{base}/panel.csv", "metadata": f"{base}/panel_metadata.json"}


def matrix_stats(fx: DataFrame, value: str = "value") -> DataFrame:
    """Overall mean / population std / min / max of a long matrix."""
    return fx.agg(F.count(F.lit(1)).alias("cells"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max"))


def export_features(matrix: DataFrame, scaled: DataFrame | None, out_dir: str, formats: Sequence[str] = ("csv", "json"),
                    entity: str = "City") -> dict[str, str]:
    """Feature matrix (and scaled matrix) as CSV / JSON, plus metadata
    (rows, columns, overall statistics of the values)."""
    from ..operators.features import to_long

    base = out_dir.rstrip("/")
    paths = {}
    for name, m in [("features", matrix), ("features_scaled", scaled)]:
        if m is None:
            continue
        for fmt in formats:
            p = f"{base}/{name}.{fmt}"
            w = m.write.mode("overwrite")
            (w.option("header", "true").csv(p) if fmt == "csv" else w.json(p))
            paths[f"{name}.{fmt}"] = p
        meta = matrix_stats(to_long(m, entity)).withColumn("columns", F.lit(len(m.columns) - 1))
        meta.coalesce(1).write.mode("overwrite").json(f"{base}/{name}_metadata.json")
        paths[f"{name}_metadata"] = f"{base}/{name}_metadata.json"
    return paths


def export_runs(runs: DataFrame, labels: DataFrame, out_dir: str, cluster: str = "cluster") -> dict[str, str]:
    """``runs`` (run, algorithm, k, execution_time, metrics) as the CSV
    comparison summary, without failed runs, and per run one JSON record in
    the folder of its algorithm and k: time, metrics and cluster sizes.
    ``labels`` are (run, entity, cluster) of all runs."""
    base = out_dir.rstrip("/")
    good = runs.where(F.col("error").isNull()).drop("error") if "error" in runs.columns else runs
    good.write.mode("overwrite").option("header", "true").csv(f"{base}/comparison_summary.csv")
    sizes = labels.groupBy("run", cluster).agg(F.count(F.lit(1)).alias("size")).groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct(cluster, "size"))).alias("cluster_sizes"))  # k entries a run
    good.join(sizes, "run").write.mode("overwrite").partitionBy("algorithm", "k").json(f"{base}/runs")
    return {"summary": f"{base}/comparison_summary.csv", "runs": f"{base}/runs"}
