"""Report tables (R1-R12): the datasets behind the trend, radar, box-plot,
correlation, projection, silhouette and map views, one flat DataFrame each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import pearson_pvalue
from ..session import checkpoint
from . import evaluate as ev
from .clean import _year_ranges, drop_null_keys
from .joins import attach_clusters, attach_coordinates, dense_grid
from .setops import sort_desc

# ---------------------------------------------------------------- R1, R2
def monthly_trends(df: DataFrame, labels: DataFrame, items: Sequence[str] | None = None, years: Sequence[int] | None = None,
                   dense: bool = True, entity="City", item="Commodity", ts="Date", value="Price", cluster="Cluster") -> DataFrame:
    """Mean price per item x cluster x (year, month).  Dense: for every
    (item, cluster) present, all 12 months of every selected year, NULL where
    there is no price."""
    if years:  # date ranges, which reach the scan
        df = df.where(_year_ranges(years, ts))
    d = attach_clusters(df, labels, entity, cluster).withColumn("Year", F.year(ts)).withColumn("Month", F.month(ts))
    if items:
        d = d.where(F.col(item).isin(list(items)))
    d = d.where(F.col(cluster).isNotNull())
    facts = d.groupBy(item, cluster, "Year", "Month").agg(F.avg(value).alias("avg_price"))
    if not dense:
        return facts
    ys = sorted(int(y) for y in years) if years else sorted(r[0] for r in d.select("Year").distinct().collect() if r[0] is not None)
    base = d.select(item, cluster).distinct()
    return dense_grid(facts, base, {"Year": ys, "Month": list(range(1, 13))}, [item, cluster, "Year", "Month"])


def monthly_trends_sparse(df: DataFrame, labels: DataFrame, top: int | None = None, entity="City", item="Commodity", ts="Date",
                          value="Price", cluster="Cluster") -> DataFrame:
    """R2: chart form - NULL date/price/cluster rows dropped, months as the
    first day of the month; with ``top`` only the first so many items
    alphabetically."""
    d = drop_null_keys(attach_clusters(df, labels, entity, cluster), [ts, value, cluster])
    if top:
        first = d.select(item).distinct().orderBy(item).limit(top)
        d = d.join(F.broadcast(first), item, "left_semi")
    return d.groupBy(item, cluster, F.date_trunc("month", F.col(ts)).alias("Month")).agg(F.avg(value).alias("avg_price"))


# ---------------------------------------------------------------- R3
def radar_profile(df: DataFrame, labels: DataFrame, entity="City", item="Commodity", value="Price", cluster="Cluster",
                  digits: int | None = 3) -> DataFrame:
    """Per cluster x item the mean price scaled to [0, 1] across clusters
    (per item); 0.5 when all clusters are equal or only one cluster has the
    item; NULL where a cluster lacks the item; empty below 3 items."""
    d = attach_clusters(df, labels, entity, cluster).where(F.col(cluster).isNotNull())
    avg = d.groupBy(cluster, item).agg(F.avg(value).alias("_m"))
    per_item = avg.groupBy(item).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"), F.count("_m").alias("_nc"))
    items = d.select(item).distinct()
    clusters = d.select(cluster).distinct()
    n_items = items.count()
    if n_items < 3:
        return avg.limit(0).select(cluster, item, F.lit(None).cast("double").alias("value"))
    its = sorted(r[0] for r in items.collect())
    grid = dense_grid(avg, clusters, {item: its}, [cluster, item]).join(per_item, item, "left")
    v = F.when(F.col("_m").isNull(), F.lit(None).cast("double")).when(
        (F.col("_nc") <= 1) | (F.col("_hi") <= F.col("_lo")), F.lit(0.5)
    ).otherwise((F.col("_m") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    if digits is not None:
        v = F.bround(v, digits)
    return grid.select(cluster, item, v.alias("value"))


# ---------------------------------------------------------------- R4
def boxplot_stats(df: DataFrame, labels: DataFrame, entity="City", item="Commodity", ts="Date", value="Price", cluster="Cluster") -> tuple[DataFrame, DataFrame]:
    """Per item x year x cluster: min, Q1, median, Q3, max, mean,
    population std (NULL prices ignored); dense over all items, years and
    clusters with NULL statistics where a cell is empty.  Outliers (outside
    1.5 IQR) are returned as rows (item, year, cluster, value), never
    collected into one list."""
    d = attach_clusters(df.select(entity, item, ts, value), labels, entity, cluster).withColumn("Year", F.year(ts))
    # read by the statistics, both passes of the quartiles and the outlier pass
    d = checkpoint(d.where(F.col(cluster).isNotNull()).select(item, "Year", cluster, value))
    keys = [item, "Year", cluster]
    v = F.col(value)
    basic = d.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    q = exact_quantiles(d, keys, value, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    stats = checkpoint(basic.join(q, keys, "left"))
    # every item, year and cluster present: one row of lists, from the statistics
    lists = stats.agg(*[F.sort_array(F.collect_set(k)).alias(f"_{k}") for k in keys])
    for k in keys:
        lists = lists.withColumn(k, F.explode(f"_{k}"))
    grid = lists.select(*keys).join(stats, keys, "left")
    grid = grid.select(*keys, "min", "q1", "median", "q3", "max", "mean", "std")
    b = q.select(*keys, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"))
    outl = d.join(b, keys, "inner").where((v < F.col("_lo")) | (v > F.col("_hi"))).select(*keys, v.alias("value"))
    return grid, outl


# ---------------------------------------------------------------- R5 - R7
def correlation(df: DataFrame, labels: DataFrame | None = None, min_rows: int = 3, entity="City", item="Commodity", ts="Date",
                value="Price", cluster="Cluster", pvalues: bool = True) -> DataFrame:
    """R5 (global) / R6 (per cluster when ``labels`` are given) / R7.

    Prices are averaged per (entity, date, item) (duplicates) in the one pass
    over the rows; each (entity, date) then is one sorted array of its items,
    and a co-moment aggregate over the pairs within the arrays gives Pearson r of the
    complete pairs: covar_pop / (std_pop * std_pop), NULL for zero variance.
    Pairs are combined in the tasks that make them, so only item pairs are
    shuffled; each unordered pair is computed once and
    mirrored after the aggregate.  Output (``[cluster,]`` item_a, item_b, r, n,
    p); per cluster, a cluster with fewer than ``min_rows`` (entity, date)
    rows gets NULL r and p.  p is the two-sided t-test p-value (>= 3 pairs),
    1.0 on the diagonal."""
    d = df
    ck = []
    if labels is not None:
        d = attach_clusters(df, labels, entity, cluster).where(F.col(cluster).isNotNull())
        ck = [cluster]
    g = checkpoint(d.where(F.col(item).isNotNull()).groupBy(*ck, entity, ts, item).agg(F.avg(value).alias("_x")))
    cell = F.when(F.col("_x").isNotNull(), F.struct(F.col(item).alias("i"), F.col("_x").alias("x")))
    rows = g.groupBy(*ck, entity, ts).agg(F.array_sort(F.collect_list(cell)).alias("_v"))  # at most one entry an item
    later = lambda a, at: F.transform(
        F.slice("_v", at + 1, F.size("_v")), lambda b: F.struct(a["i"].alias("item_a"), b["i"].alias("item_b"), a["x"].alias("_a"), b["x"].alias("_b")))
    pairs = rows.select(*ck, F.explode(F.flatten(F.transform("_v", later))).alias("_p")).select(*ck, "_p.*")
    half = pairs.groupBy(*ck, "item_a", "item_b").agg(
        F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )
    sides = F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    sides = F.explode(F.when(F.col("item_a") == F.col("item_b"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")
    r = half.select(*ck, sides, "r", "n").select(*ck, "s.item_a", "s.item_b", "r", "n")
    # every two items (of every cluster): the item list is one row
    one = F.lit(0).alias("_one")
    items = g.agg(F.sort_array(F.collect_set(item)).alias("_items")).select(one, "_items")
    # (entity, date) rows per cluster, for the minimum-rows rule
    base = rows.groupBy(*ck).agg(F.count(F.lit(1)).alias("_rows")).select("*", one)
    grid = base.join(items, "_one").select(*ck, "_rows", F.explode("_items").alias("item_a"), "_items").select(
        *ck, "_rows", "item_a", F.explode("_items").alias("item_b"))
    out = grid.join(r, ck + ["item_a", "item_b"], "left").select(*ck, "item_a", "item_b", "r", F.coalesce("n", F.lit(0)).alias("n"), "_rows")
    small = (F.col("_rows") < min_rows) if ck else F.lit(False)
    out = out.withColumn("r", F.when(~small, F.col("r")))
    if pvalues:
        p = F.when(F.col("item_a") == F.col("item_b"), F.lit(1.0)).otherwise(pearson_pvalue("r", "n"))
        out = out.withColumn("p", F.when(~small, p))
    return out.drop("_rows")


# ---------------------------------------------------------------- R8
def project_2d(vec: DataFrame, labels: DataFrame | None = None, names: Sequence[str] | None = None, entity="entity",
               features="features", cluster="cluster"):
    """Two-dimensional view of the feature vectors.  Fewer than 2
    features -> empty; exactly 2 -> the features as they are; more -> PCA
    on centred data (components from Spark ML's distributed covariance
    eigendecomposition; sign rule: the largest absolute loading of each
    component is positive).  Returns (points, loadings, variance)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    spark = vec.sparkSession
    dim = ev.vector_dim(vec, features)
    names = list(names) if names is not None else [f"f{i:02d}" for i in range(dim)]
    lb = labels.select(entity, cluster) if labels is not None else None
    empty_l = spark.createDataFrame([], "feature string, pc1 double, pc2 double")
    empty_v = spark.createDataFrame([], "component string, explained_variance double, explained_variance_ratio double")
    if dim < 2:
        pts = vec.select(entity).limit(0).select(entity, F.lit(None).cast("double").alias("pc1"), F.lit(None).cast("double").alias("pc2"))
        return pts, empty_l, empty_v
    if dim == 2:
        pts = vec.select(entity, F.col(features)[0].alias("pc1"), F.col(features)[1].alias("pc2"))
        if lb is not None:
            pts = pts.join(lb, entity, "left")
        return pts, empty_l, empty_v
    mean = vec.agg(*[F.avg(F.col(features)[i]).alias(f"_m{i}") for i in range(dim)]).first()
    mu = [float(mean[f"_m{i}"]) for i in range(dim)]
    centred = vec.select(entity, F.zip_with(features, F.array(*[F.lit(m) for m in mu]), lambda x, m: x - m).alias("_c"))
    model = PCA(k=2, inputCol="_v").fit(centred.select(array_to_vector("_c").alias("_v")))
    pc = np.array(model.pc.toArray(), dtype=float, copy=True)  # d x 2
    for j in range(2):
        if pc[abs(pc[:, j]).argmax(), j] < 0:
            pc[:, j] = -pc[:, j]
    dot = lambda w: F.aggregate(F.zip_with("_c", F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    pts = centred.select(entity, dot(pc[:, 0]).alias("pc1"), dot(pc[:, 1]).alias("pc2"))
    if lb is not None:
        pts = pts.join(lb, entity, "left")
    loadings = spark.createDataFrame([(n, float(pc[i, 0]), float(pc[i, 1])) for i, n in enumerate(names)], "feature string, pc1 double, pc2 double")
    total = vec.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v")).agg(F.sum("v").alias("t"))
    var = pts.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2")).withColumn("_k", F.lit(0)).join(
        total.withColumn("_k", F.lit(0)), "_k")
    variance = var.select(F.explode(F.array(
        F.struct(F.lit("pc1").alias("component"), F.col("v1").alias("explained_variance"), (F.col("v1") / F.col("t")).alias("explained_variance_ratio")),
        F.struct(F.lit("pc2").alias("component"), F.col("v2").alias("explained_variance"), (F.col("v2") / F.col("t")).alias("explained_variance_ratio")),
    )).alias("x")).select("x.*")
    return pts, loadings, variance


# ---------------------------------------------------------------- R9 - R12
def city_silhouettes(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features",
                     block_rows: int = 512) -> DataFrame:
    """Per-entity silhouettes ranked high to low, with the overall
    silhouette and Davies-Bouldin index on every row."""
    s = checkpoint(ev.silhouette_samples(vec, labels, entity, cluster, features, block_rows))
    ranked = sort_desc(s.select(entity, cluster, "silhouette"), "silhouette", [entity])
    overall = s.agg(F.avg("silhouette").alias("overall"))
    db = ev.davies_bouldin(vec, labels, entity, cluster, features)
    one = overall.withColumn("_k", F.lit(0)).join(db.withColumn("_k", F.lit(0)), "_k")
    return ranked.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")


def assignments(labels: DataFrame, coords: DataFrame, entity="City", cluster="Cluster") -> DataFrame:
    """(name, lat, lon, clusterId) for every labeled entity."""
    j = attach_coordinates(labels.select(entity, cluster), coords, entity)
    return j.select(F.col(entity).alias("name"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"),
                    F.col(cluster).alias("clusterId"))


def run_summary(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features") -> DataFrame:
    """One row per cluster: size, total n, k and the run's silhouette,
    Davies-Bouldin and Calinski-Harabasz (unrounded)."""
    m = ev.metrics_table(vec, labels, entity, cluster, features)
    sizes = labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    tot = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("k"))
    one = m.withColumn("_k", F.lit(0)).join(tot.withColumn("_k", F.lit(0)), "_k")
    return sizes.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k").drop("_k")


def run_simple(labels: DataFrame, algorithm: str, k: int, entity="entity", cluster="cluster") -> tuple[DataFrame, DataFrame]:
    """R11, simple form: (entity, cluster, algorithm, k) for every entity, and
    one row per cluster with its size, algorithm, k and the total."""
    sizes = labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = F.broadcast(labels.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(0)))
    run = (F.lit(algorithm).alias("algorithm"), F.lit(int(k)).alias("k"))
    return labels.select(entity, cluster, *run), sizes.withColumn("_k", F.lit(0)).join(total, "_k").select(cluster, "size", "total", *run)


def run_detailed(vec: DataFrame, labels: DataFrame, algorithm: str, k: int, centers: DataFrame | None = None,
                 execution_time: float | None = None, coords: DataFrame | None = None, entity="entity", cluster="cluster",
                 features="features") -> dict[str, DataFrame]:
    """R11, detailed form: ``assignments`` (with coordinates if given),
    ``metrics`` (one row: every metric with algorithm, k and time) and ``sizes``."""
    m = ev.evaluate(vec, labels, algorithm, centers, entity, cluster, features)
    who, sizes = run_simple(labels, algorithm, k, entity, cluster)
    if coords is not None:
        who = assignments(labels, coords, entity, cluster)
    head = (F.lit(algorithm).alias("algorithm"), F.lit(int(k)).alias("k"), F.lit(execution_time).cast("double").alias("execution_time"))
    return {"assignments": who, "metrics": m.select(*head, "*"), "sizes": sizes}


def report(df: DataFrame, vec: DataFrame, panel_labels: DataFrame, vec_labels: DataFrame, coords: DataFrame | None = None,
           entity="City", item="Commodity", ts="Date", value="Price", names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The bundle of report tables over one checkpointed panel; parts
    that would be empty are skipped.  All tables of the panel have rows if it has any, those of the
    vectors likewise; only the outliers have to be looked for."""
    d = checkpoint(df.select(entity, item, ts, value))
    cols = {"entity": entity, "item": item, "ts": ts, "value": value}
    box, outliers = boxplot_stats(d, panel_labels, **cols)
    points, loadings, variance = project_2d(vec, vec_labels, names)
    parts: dict[str, DataFrame] = {
        "monthly_trends": monthly_trends(d, panel_labels, **cols),
        "radar": radar_profile(d, panel_labels, entity, item, value),
        "boxplot": box,
        "boxplot_outliers": outliers,
        "correlation": correlation(d, **cols),
        "correlation_per_cluster": correlation(d, panel_labels, **cols),
        "silhouettes": city_silhouettes(vec, vec_labels),
        "projection": points,
        "loadings": loadings,
        "variance": variance,
        "years": d.select(F.year(ts).alias("year")).distinct(),
    }
    if coords is not None:
        parts["assignments"] = assignments(panel_labels, coords, entity)
    drop = {name for name in ("boxplot_outliers", "projection", "loadings", "variance") if parts[name].isEmpty()}
    priced = attach_clusters(d, panel_labels, entity).where(F.col("Cluster").isNotNull())
    if priced.isEmpty():
        drop |= {"monthly_trends", "radar", "boxplot", "correlation_per_cluster"}
    if d.isEmpty():
        drop |= {"correlation", "years"}
    if vec_labels.isEmpty():
        drop.add("silhouettes")
    if coords is not None and panel_labels.isEmpty():
        drop.add("assignments")
    return {k: v for k, v in parts.items() if k not in drop}
