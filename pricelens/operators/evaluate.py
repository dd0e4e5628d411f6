"""Clustering quality metrics (E1-E10) on vectors ``(entity, features
array<double>)`` and labels ``(entity, cluster)``.

Distances are Euclidean (not squared; Spark ML's ClusteringEvaluator uses
squared distances and is therefore not used).  Pair-based metrics go through
the tile engine in ``pairwise``; centroid-based ones are aggregates plus a
join with the (k-row) centroid table."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Collection
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles
from ..session import broadcast_checked, checkpoint
from . import pairwise as pw
from .cluster import sum_arrays


def vector_dim(vec: DataFrame, features: str = "features") -> int:
    r = vec.select(F.max(F.size(features))).first()[0]
    return int(r or 0)


def sq_dist(a, b):
    """Squared Euclidean distance of two array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def labeled(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features") -> DataFrame:
    return vec.select(entity, features).join(labels.select(entity, cluster), entity, "inner")


def centroids(lv: DataFrame, dim: int, cluster="cluster", features="features") -> DataFrame:
    """(cluster, center array<double>, size) with one aggregate (d avg columns)."""
    aggs = [F.avg(F.col(features)[i]).alias(f"_c{i}") for i in range(dim)]
    c = lv.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *aggs)
    return c.select(cluster, F.array(*[F.col(f"_c{i}") for i in range(dim)]).alias("center"), "size")


# ---------------------------------------------------------------- E1, E8
def silhouette_samples(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features",
                       block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """E1 per row: (entity, cluster, a, b, silhouette); singleton cluster -> 0."""
    lv = labeled(vec, labels, entity, cluster, features)
    sums = pw.cluster_distance_sums(lv, entity, cluster, features, block_rows=block_rows)
    mean = F.try_divide(F.col("dsum"), F.col("cnt"))
    own = sums.where(F.col(cluster) == F.col("other")).select(entity, cluster, F.col("cnt").alias("_own_n"), mean.alias("a"))
    other = sums.where((F.col(cluster) != F.col("other")) & (F.col("cnt") > 0)).groupBy(entity).agg(F.min(mean).alias("b"))
    s = own.join(other, entity, "left")
    sil = F.when((F.col("_own_n") == 0) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.select(entity, cluster, "a", "b", sil.alias("silhouette"))


def silhouette(vec: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """E1 overall: one row (silhouette = mean of the per-row values)."""
    return silhouette_samples(vec, labels, **kw).agg(F.avg("silhouette").alias("silhouette"))


def pair_metrics(vec: DataFrame, labelings: DataFrame, again: bool = False, run="run", entity="entity", cluster="cluster", features="features",
                 block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> dict[int, dict[str, float | None]]:
    """Silhouette, mean and deviation of the intra-cluster distances of many labelings (run, entity, cluster)
    of the same vectors, from one walk over the pairs of rows whose distances serve every labeling: by run,
    what ``silhouette`` and ``intra_distance`` give run by run.  Entities may come several times on either side:
    as in ``labeled``, each of their vectors then counts with each of their labels; ``again`` counts the rows
    as ``evaluate`` does, which joins the labeled rows to their labels once more.  Without ``again`` only the
    silhouette is found.  Only sums by (run, cluster) reach the driver."""
    spark = vec.sparkSession
    each = labelings.select(F.col(run).alias("_r"), entity, F.col(cluster).cast("int").alias("_k"))
    found = sorted((r[0], r[1]) for r in each.where("_k is not null").select("_r", "_k").distinct().collect())
    if not found:
        return {}
    number = spark.createDataFrame([(r, k, s) for s, (r, k) in enumerate(found)], "_r int, _k int, _s int")
    # one row an entity: how often its vectors count, by slot, a place in ``found``
    n = each.groupBy(entity, "_r", "_k").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if again:
        all_of = each.groupBy(entity, "_r").agg(F.count(F.lit(1)).alias("_all"))
        copies = vec.groupBy(entity).agg(F.count(F.lit(1)).alias("_m"))
        n = n.join(all_of, [entity, "_r"]).join(copies, entity).withColumn("_n", F.col("_n") * F.col("_all") * F.col("_m"))
    n = n.join(F.broadcast(number), ["_r", "_k"]).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_n"))).alias("_of"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(len(found) - 1)), lambda s: F.coalesce(F.try_element_at("_of", s), F.lit(0.0)))
    rows = checkpoint(vec.select(entity, features).join(n, entity).select(entity, features, weights.alias("_w")))

    sums = pw.weighted_distance_sums(rows, len(found), entity, "_w", features, again, block_rows).groupBy(entity).agg(
        sum_arrays("s", len(found)).alias("s"), *([sum_arrays("z", len(found)).alias("z")] if again else []), F.sum("m").alias("m"))
    sums = sums.join(rows.groupBy(entity).agg(F.any_value("_w").alias("w")), entity)
    size = rows.agg(*[F.sum(F.col("_w")[s]) for s in range(len(found))]).first()
    span: dict[int, list[int]] = {}
    for s, (r, _) in enumerate(found):
        span.setdefault(r, []).append(s)
    info = [(s, r, span[r][0], s - span[r][0], [size[o] for o in span[r]]) for s, (r, _) in enumerate(found)]
    info = F.broadcast(spark.createDataFrame(info, "_s int, _r int, _a int, _i int, _n array<double>"))
    one = sums.select("s", "w", "m", *(["z"] if again else []), F.posexplode("w").alias("_s", "_own")).where("_own > 0").join(info, "_s")
    part = lambda c: F.slice(c, F.col("_a") + 1, F.size("_n"))
    several = F.size(F.filter(part("w"), lambda x: x > 0)) > 1  # an entity of several clusters: the nearest other of any of them
    mean = F.transform(part("s"), lambda x, o: F.when((o != F.col("_i")) | several, x / (F.col("m") * F.get("_n", o))))  # array_min passes over NULL
    others = F.get("_n", F.col("_i")) - 1
    mine = F.get("s", F.col("_s"))
    one = one.withColumn("a", F.try_divide(mine, F.col("m") * others)).withColumn("b", F.array_min(mean))
    sil = F.when((others == 0) | F.col("b").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    # of the own cluster: the distances, and the pairs at distance 0 with those of a row counted several times
    inner = [F.sum(F.col("_own") * mine).alias("d"), F.sum(F.col("_own") * F.get("z", F.col("_s")) + F.col("m") * F.col("_own") * F.col("_own")).alias("z")] if again else []
    got = {r["_s"]: r for r in one.groupBy("_s").agg(F.sum(sil).alias("sil"), F.count(F.lit(1)).alias("n"), *inner).collect()}
    out = {}
    for r, at in span.items():
        mine = [(size[s], got[s]) for s in at if s in got]
        out[r] = {"silhouette": sum(x["sil"] for _, x in mine) / sum(x["n"] for _, x in mine) if mine else None}
        if again:
            apart = [(n * n - x["z"], x["d"]) for n, x in mine]
            m = [d / pairs for pairs, d in apart if pairs > 0]
            out[r] |= {"avg_intra_cluster_distance": float(np.mean(m)) if m else None, "std_intra_cluster_distance": float(np.std(m)) if m else None}
    return out


def silhouette_by_cluster(samples: DataFrame, cluster="cluster") -> DataFrame:
    """Per cluster mean, population std, min, max, size, number of rows
    below the overall mean, and whether the cluster mean is above it."""
    overall = samples.agg(F.avg("silhouette").alias("_overall"))
    # one-row overall mean, broadcast (proven size) to every sample row
    s = samples.withColumn("_k", F.lit(0)).join(F.broadcast(overall.withColumn("_k", F.lit(0))), "_k")
    return s.groupBy(cluster).agg(
        F.avg("silhouette").alias("mean"),
        F.stddev_pop("silhouette").alias("std"),
        F.min("silhouette").alias("min"),
        F.max("silhouette").alias("max"),
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("silhouette") < F.col("_overall")).alias("below_overall"),
        (F.avg("silhouette") > F.first("_overall")).alias("above_average"),
    )


# ---------------------------------------------------------------- E2, E3, E6, E7
def _prepared(vec, labels, entity, cluster, features):
    """Labeled vectors (kept), their dimension and the centroid table (kept):
    shared by the centroid-based metrics."""
    lv = labeled(vec, labels, entity, cluster, features).persist()
    dim = vector_dim(lv, features)
    return lv, dim, centroids(lv, dim, cluster, features).persist()


def _center_pairs(cent: DataFrame, cluster="cluster") -> DataFrame:
    """Distances between every two centers, through an equi-join of the
    (cluster, dim, value) rows on the dimension (k^2 d rows, k = clusters)."""
    lc = cent.select(cluster, F.posexplode("center").alias("dim", "v"))
    a = lc.select(F.col(cluster).alias("ci"), "dim", F.col("v").alias("vi"))
    b = lc.select(F.col(cluster).alias("cj"), "dim", F.col("v").alias("vj"))
    return a.join(b, "dim").groupBy("ci", "cj").agg(F.sqrt(F.sum((F.col("vi") - F.col("vj")) ** 2)).alias("d"))


def davies_bouldin(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features",
                   _pre: tuple | None = None) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j), s = mean
    distance of members to their centroid; coincident centroids contribute 0."""
    lv, dim, cent = _pre or _prepared(vec, labels, entity, cluster, features)
    s = lv.join(broadcast_checked(cent.select(cluster, "center")), cluster).groupBy(cluster).agg(
        F.avg(F.sqrt(sq_dist(F.col(features), F.col("center")))).alias("s"))
    pairs = _center_pairs(cent, cluster).where(F.col("ci") != F.col("cj"))
    r = (
        pairs.join(s.select(F.col(cluster).alias("ci"), F.col("s").alias("si")), "ci")
        .join(s.select(F.col(cluster).alias("cj"), F.col("s").alias("sj")), "cj")
        .withColumn("ratio", F.when(F.col("d") == 0, F.lit(0.0)).otherwise((F.col("si") + F.col("sj")) / F.col("d")))
        .groupBy("ci").agg(F.max("ratio").alias("m"))
    )
    return r.agg(F.avg("m").alias("davies_bouldin"))


def variance_split(vec: DataFrame, labels: DataFrame, centers: DataFrame | None = None, entity="entity", cluster="cluster",
                   features="features", _pre: tuple | None = None) -> DataFrame:
    """WCSS (= inertia, to ``centers`` if given, else centroids), BCSS,
    TSS and explained ratio BCSS / TSS (NULL when TSS = 0)."""
    lv, dim, cent = _pre or _prepared(vec, labels, entity, cluster, features)
    use = cent.select(cluster, "center") if centers is None else centers.select(cluster, "center")
    overall = lv.agg(*[F.avg(F.col(features)[i]).alias(f"_o{i}") for i in range(dim)]).select(
        F.array(*[F.col(f"_o{i}") for i in range(dim)]).alias("_overall"), F.lit(0).alias("_k"))
    ov = F.broadcast(overall)
    w = lv.join(broadcast_checked(use), cluster).withColumn("_k", F.lit(0)).join(ov, "_k").agg(
        F.sum(sq_dist(F.col(features), F.col("center"))).alias("wcss"),
        F.sum(sq_dist(F.col(features), F.col("_overall"))).alias("tss"),
    )
    b = cent.join(broadcast_checked(use.withColumnRenamed("center", "_u")), cluster).withColumn("_k", F.lit(0)).join(ov, "_k").agg(
        F.sum(F.col("size") * sq_dist(F.col("_u"), F.col("_overall"))).alias("bcss"))
    out = w.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return out.select("wcss", "bcss", "tss", F.when(F.col("tss") > 0, F.col("bcss") / F.col("tss")).alias("explained_variance_ratio"))


def calinski_harabasz(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features",
                      _pre: tuple | None = None) -> DataFrame:
    """(BCSS / (k - 1)) / (WCSS / (n - k)); 1.0 when WCSS = 0."""
    v = variance_split(vec, labels, None, entity, cluster, features, _pre=_pre)
    kn = labels.agg(F.count_distinct(cluster).alias("_kc"), F.count(F.lit(1)).alias("_n"))
    j = v.withColumn("_k", F.lit(0)).join(kn.withColumn("_k", F.lit(0)), "_k")
    ch = F.when(F.col("wcss") == 0, F.lit(1.0)).otherwise(
        (F.col("bcss") / (F.col("_kc") - 1)) / (F.col("wcss") / (F.col("_n") - F.col("_kc"))))
    return j.select(ch.alias("calinski_harabasz"))


def inter_distance(centers: DataFrame, cluster="cluster") -> DataFrame:
    """Mean and min of the non-zero distances between distinct centers."""
    p = _center_pairs(centers, cluster).where((F.col("ci") < F.col("cj")) & (F.col("d") > 0))
    return p.agg(F.avg("d").alias("avg_inter_cluster_distance"), F.min("d").alias("min_inter_cluster_distance"))


# ---------------------------------------------------------------- E4, E5
def size_balance(labels: DataFrame, cluster="cluster") -> DataFrame:
    """Min / max / population std of cluster sizes and min/max ratio."""
    s = labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return s.agg(
        F.min("n").alias("min_cluster_size"),
        F.max("n").alias("max_cluster_size"),
        F.stddev_pop("n").alias("cluster_size_std"),
        (F.min("n") / F.max("n")).alias("cluster_balance"),
    )


def intra_distance(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features",
                   block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """E5: per cluster the mean non-zero pair distance; then the mean and
    population std of those means over clusters."""
    lv = labeled(vec, labels, entity, cluster, features)
    per = pw.intra_pair_sums(lv, entity, cluster, features, block_rows=block_rows).where(F.col("cnt") > 0)
    per = per.select(cluster, (F.col("dsum") / F.col("cnt")).alias("m"))
    return per.agg(F.avg("m").alias("avg_intra_cluster_distance"), F.stddev_pop("m").alias("std_intra_cluster_distance"))


# ---------------------------------------------------------------- E9
HIGHER_IS_BETTER = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True}


def compare_runs(metrics: DataFrame, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """E9 over a long metrics table (run, metric, value): per run ranks
    (descending for silhouette / Calinski-Harabasz, ascending for
    Davies-Bouldin) and per metric mean / population std / min / max.
    Fewer than two runs is an error."""
    n = metrics.select(run).distinct().count()
    if n < 2:
        raise ValueError("at least two runs are needed to compare")
    hib = F.create_map(*[x for k, v in HIGHER_IS_BETTER.items() for x in (F.lit(k), F.lit(v))])
    signed = F.when(F.coalesce(hib[F.col("metric")], F.lit(True)), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric").orderBy(signed.asc_nulls_last(), F.col(run).asc())
    ranks = metrics.withColumn("rank", F.row_number().over(w))
    summary = metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return ranks, summary


# ---------------------------------------------------------------- E10
def adjusted_rand(lb1: DataFrame, lb2: DataFrame, entity="entity", cluster="cluster") -> DataFrame:
    """Adjusted Rand Index of two labelings joined by entity (common rows
    only), from the contingency table."""
    j = lb1.select(entity, F.col(cluster).alias("_u")).join(lb2.select(entity, F.col(cluster).alias("_v")), entity)
    cont = j.groupBy("_u", "_v").agg(F.count(F.lit(1)).alias("nij"))
    c2 = lambda x: x * (x - 1) / 2.0
    a = cont.groupBy("_u").agg(F.sum("nij").alias("a")).agg(F.sum(c2(F.col("a"))).alias("sa"))
    b = cont.groupBy("_v").agg(F.sum("nij").alias("b")).agg(F.sum(c2(F.col("b"))).alias("sb"))
    t = cont.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    k = F.lit(0)
    m = t.withColumn("_k", k).join(a.withColumn("_k", k), "_k").join(b.withColumn("_k", k), "_k")
    expected = F.col("sa") * F.col("sb") / c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == expected, F.lit(1.0)).otherwise((F.col("sij") - expected) / (mx - expected))
    return m.select(ari.alias("ari"))


def pairwise_ari(labelings: DataFrame, run: str = "run", entity="entity", cluster="cluster") -> DataFrame:
    """Adjusted Rand Index of every two runs of a long table (run, entity, cluster) on the
    entities they share: (i, j, ari), i < j.  Each entity's runs become one array, whose pairs feed
    one contingency aggregate (i, j, u, v); two runs that share no entity get no row, a single one 1.0."""
    mine = F.struct(F.col(run).alias("r"), F.col(cluster).alias("c"))
    rows = labelings.groupBy(entity).agg(F.array_sort(F.collect_list(mine)).alias("_v"))  # one entry a run
    later = lambda a, at: F.transform(
        F.slice("_v", at + 2, F.size("_v")), lambda b: F.struct(a["r"].alias("i"), b["r"].alias("j"), a["c"].alias("u"), b["c"].alias("v")))
    cont = rows.select(F.explode(F.flatten(F.transform("_v", later))).alias("_p")).select("_p.*").groupBy("i", "j", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda x: x * (x - 1) / 2.0
    # the table's margins: each count goes to its cell, its row, its column and the total
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("u") if k in "cu" else F.lit(None).cast("int")).cast("long").alias("a"),
                               (F.col("v") if k in "cv" else F.lit(None).cast("int")).cast("long").alias("b")) for k in "cuvt"])
    sums = cont.select("i", "j", "n", F.explode(kinds).alias("_k")).select("i", "j", "n", "_k.*").groupBy("i", "j", "k", "a", "b").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("k") == k, c2(F.col("n"))).otherwise(0.0))
    t = sums.groupBy("i", "j").agg(of("c").alias("sij"), of("u").alias("sa"), of("v").alias("sb"), of("t").alias("all"))
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), F.col("all")), F.lit(0.0))
    mx = (F.col("sa") + F.col("sb")) / 2
    return t.select("i", "j", F.when(mx == expected, F.lit(1.0)).otherwise((F.col("sij") - expected) / (mx - expected)).alias("ari"))


def sample_thresholds(vec: DataFrame, n: int, ratio: float, seed: int, entity="entity") -> tuple[DataFrame, dict[int, float]]:
    """Rows with one 53-bit hash a run (array ``_h``) and, by run, the value between the k-th smallest
    hash and the next (k = round(ratio * rows)): rows below it are the run's sample, whatever the
    partitions.  All runs take the two passes of one quantile."""
    hashed = vec.withColumn("_h", F.array(*[F.shiftrightunsigned(F.xxhash64(F.col(entity), F.lit(seed + i)), 11).cast("double") for i in range(n)]))
    rows = vec.count()
    keep = int(round(ratio * rows))
    if keep == 0 or keep >= rows:
        return hashed, dict.fromkeys(range(n), math.inf if keep else -1.0)
    long = hashed.select(F.posexplode("_h").alias("run", "h"))
    found = exact_quantiles(long, ["run"], "h", [(keep - 0.5) / (rows - 1)], names=["t"])
    return hashed, {r["run"]: r["t"] for r in found.collect()}  # one row a run


def stability(vec: DataFrame, fit: Callable[[DataFrame, int], DataFrame], k: int, n: int = 10, ratio: float = 0.8, seed: int = 42,
              entity="entity", cluster="cluster") -> tuple[DataFrame, DataFrame]:
    """Fit ``n`` subsamples of ``ratio`` rows, compare every pair of
    labelings by ARI on the entities they share.  Returns (pairs, summary)."""
    hashed, limits = sample_thresholds(vec, n, ratio, seed, entity)
    runs = [fit(hashed.where(F.col("_h")[i] < limits[i]).drop("_h"), k).select(F.lit(i).alias("run"), entity, cluster) for i in range(n)]
    pairs = checkpoint(pairwise_ari(functools.reduce(DataFrame.unionByName, runs), "run", entity, cluster))
    summary = pairs.agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("std"), F.min("ari").alias("min"),
                        F.max("ari").alias("max"), F.count(F.lit(1)).alias("count"))
    return pairs, summary


def metrics_table(vec: DataFrame, labels: DataFrame, entity="entity", cluster="cluster", features="features", pairs: dict | None = None) -> DataFrame:
    """One row: silhouette, davies_bouldin, calinski_harabasz for a labeling; ``pairs``: its ``pair_metrics``,
    where it was walked together with others."""
    k = F.lit(0)
    pre = _prepared(vec, labels, entity, cluster, features)
    if pairs is None:
        s = silhouette(vec, labels, entity=entity, cluster=cluster, features=features)
    else:
        s = vec.sparkSession.createDataFrame([(pairs["silhouette"],)], "silhouette double")
    s = s.withColumn("_k", k)
    d = davies_bouldin(vec, labels, entity, cluster, features, _pre=pre).withColumn("_k", k)
    c = calinski_harabasz(vec, labels, entity, cluster, features, _pre=pre).withColumn("_k", k)
    return s.join(d, "_k").join(c, "_k").drop("_k")



CORE = ("silhouette", "davies_bouldin", "calinski_harabasz")
QUALITY = ("min_cluster_size", "max_cluster_size", "cluster_size_std", "cluster_balance", "avg_intra_cluster_distance",
           "std_intra_cluster_distance", "avg_inter_cluster_distance", "min_inter_cluster_distance")
FIT = ("wcss", "inertia", "bcss", "tss", "explained_variance_ratio")
METRICS = CORE + QUALITY + FIT
METRICS_SCHEMA = ", ".join(f"{m} {'long' if m in QUALITY[:2] else 'double'}" for m in METRICS)


def evaluate(vec: DataFrame, labels: DataFrame, algorithm: str | None = None, centers: DataFrame | None = None, entity="entity",
             cluster="cluster", features="features", pairs: dict | None = None) -> DataFrame:
    """All metrics of one labeling as one row (``METRICS``): the core and the
    quality metrics; center distances only with ``centers``; the sums of
    squares only for k-means with centers, NULL otherwise.  Fewer than two
    clusters are an error.  The labeled rows and centroids are kept while the
    metrics run and released before the return.  ``pairs``: what ``pair_metrics`` (``again``) found
    for the labeling, where it was walked together with others."""
    if labels.select(cluster).distinct().limit(2).count() < 2:
        raise ValueError("insufficient clusters: at least two are needed")
    pre = _prepared(vec, labels, entity, cluster, features)
    lv, own = pre[0], pre[0].select(entity, cluster)
    parts = [
        davies_bouldin(vec, own, entity, cluster, features, _pre=pre),
        calinski_harabasz(vec, own, entity, cluster, features, _pre=pre),
        size_balance(own, cluster),
    ]
    if pairs is None:
        parts.append(silhouette(lv.select(entity, features), own, entity=entity, cluster=cluster, features=features))
        parts.append(intra_distance(lv.select(entity, features), own, entity, cluster, features))
    if centers is not None:
        parts.append(inter_distance(centers, cluster))
        if algorithm == "kmeans":
            parts.append(variance_split(vec, own, centers, entity, cluster, features, _pre=pre).withColumn("inertia", F.col("wcss")))
    pre[2].count()  # kept once, before the parts read it side by side
    with ThreadPool(len(parts)) as pool:  # independent one-row jobs share the cluster
        rows = pool.map(inheritable_thread_target(vec.sparkSession)(DataFrame.first), parts)
    got = {name: x for row in rows for name, x in row.asDict().items()} | (pairs or {})
    lv.unpersist()
    pre[2].unpersist()
    return vec.sparkSession.createDataFrame([tuple(got.get(m) for m in METRICS)], METRICS_SCHEMA)


# ---------------------------------------------------------------- all metrics of many labelings
def evaluate_runs(vec: DataFrame, labelings: DataFrame, centers: DataFrame | None = None, with_sums: Collection[int] = (), run="run",
                  entity="entity", cluster="cluster", features="features", block_rows: int | None = pw.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """All metrics of many labelings (run, entity, cluster) of the same vectors: one row (run, ``METRICS``)
    a run, with the values that ``evaluate`` gives run by run.  ``centers`` (run, cluster, center) are
    those of the fits that have any; the runs ``with_sums`` also get the sums of squares to them.

    The jobs do not multiply with the runs: one aggregate for all centroids, one for all spreads,
    and one walk over the pairs of rows, whose distances serve every labeling.  Only centers and sums by
    (run, cluster) reach the driver.  A run with fewer than two clusters has no row."""
    spark = vec.sparkSession
    found = labelings.where(F.col(cluster).isNotNull()).groupBy(run, cluster).agg(F.count(F.lit(1))).select(run, cluster).collect()
    of_run: dict[int, list[int]] = {}
    for r, c in sorted((r[0], r[1]) for r in found):
        of_run.setdefault(r, []).append(c)
    of_run = {r: cs for r, cs in of_run.items() if len(cs) > 1}
    schema = f"{run} int, {METRICS_SCHEMA}"
    if not of_run:
        return spark.createDataFrame([], schema)
    names = [(r, c) for r, cs in of_run.items() for c in cs]  # a slot is a place in this list
    first = {r: names.index((r, cs[0])) for r, cs in of_run.items()}
    order = {r: i for i, r in enumerate(of_run)}

    # one row an entity: the slots it lies in, by run
    slots = spark.createDataFrame([(r, c, order[r], s) for s, (r, c) in enumerate(names)], f"{run} int, {cluster} int, _r int, _s int")
    placed = labelings.join(F.broadcast(slots), [run, cluster]).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_s"))).alias("_m"))
    runs = F.sequence(F.lit(0), F.lit(len(order) - 1))
    own = F.transform(runs, lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(-1)))
    rows = checkpoint(vec.select(entity, features).join(placed, entity).select(entity, features, own.alias("_c")))

    # centroids, then the spread around them, around the given centers and around each run's mean
    long = rows.select(features, F.explode(F.filter("_c", lambda s: s >= 0)).alias("_s"))
    means = {r["_s"]: r for r in centroids(long, vector_dim(rows, features), "_s", features).collect()}
    size = np.array([means[s]["size"] for s in range(len(names))], dtype=np.int64)
    mean = np.array([means[s]["center"] for s in range(len(names))], dtype=np.float64)
    given = {} if centers is None else {(r[run], r[cluster]): r["center"] for r in centers.select(run, cluster, "center").collect()}
    span = {r: slice(first[r], first[r] + len(cs)) for r, cs in of_run.items()}
    middle = {r: np.average(mean[at], axis=0, weights=size[at]) for r, at in span.items()}
    around = [(s, mean[s].tolist(), given.get(names[s]), middle[names[s][0]].tolist()) for s in range(len(names))]
    around = F.broadcast(spark.createDataFrame(around, "_s int, _mean array<double>, _given array<double>, _mid array<double>"))
    to = lambda c: sq_dist(F.col(features), F.col(c))
    spread = {r["_s"]: r for r in long.join(around, "_s").groupBy("_s").agg(
        F.avg(F.sqrt(to("_mean"))).alias("s"), F.sum(to("_mean")).alias("w"), F.sum(to("_given")).alias("g"), F.sum(to("_mid")).alias("t")).collect()}

    # pairs of rows
    sums = pw.run_distance_sums(rows, len(names), entity, "_c", features, block_rows).groupBy(entity).agg(
        F.any_value("_c").alias("_c"), sum_arrays("s", len(names)).alias("s"), sum_arrays("z", len(order)).alias("z"))
    info = [(order[r], first[r], size[at].tolist()) for r, at in span.items()]
    info = F.broadcast(spark.createDataFrame(info, "_r int, _a int, _n array<bigint>"))
    each = sums.select("s", "z", F.posexplode("_c").alias("_r", "_s")).where(F.col("_s") >= 0).join(info, "_r")
    each = each.select("_s", F.col("z")[F.col("_r")].alias("z"), "_n", (F.col("_s") - F.col("_a")).alias("_i"), F.slice("s", F.col("_a") + 1, F.size("_n")).alias("_d"))
    others = F.transform("_d", lambda x, i: F.when(i != F.col("_i"), x / F.get("_n", i)))  # array_min passes over NULL
    each = each.select("_s", "z", F.get("_d", F.col("_i")).alias("d"), (F.get("_n", F.col("_i")) - 1).alias("n"), F.array_min(others).alias("b"))
    a = F.try_divide("d", "n")
    sil = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, "b")), F.lit(0.0)))
    pairs = {r["_s"]: r for r in each.groupBy("_s").agg(F.sum(sil).alias("sil"), F.sum("d").alias("d"), F.sum("z").alias("z")).collect()}

    of_fit: dict[int, list] = {}
    for (r, _), c in given.items():
        of_fit.setdefault(r, []).append(c)
    out = [(r, *_run_metrics(size[at], mean[at], middle[r], [given.get(names[s]) for s in range(at.start, at.stop)], of_fit.get(r, []),
                             [spread[s] for s in range(at.start, at.stop)], [pairs[s] for s in range(at.start, at.stop)], r in with_sums))
           for r, at in span.items()]
    return spark.createDataFrame(out, schema)


def _run_metrics(n, mean, middle, given, centers, spread, pairs, with_sums) -> tuple:
    """``METRICS`` of one run from its sums by cluster; ``given`` holds the centers of clusters with rows, ``centers`` all."""
    got = {}
    between = np.sqrt(((mean[:, None, :] - mean[None, :, :]) ** 2).sum(axis=2))
    s = np.array([x["s"] for x in spread])
    ratio = np.divide(s[:, None] + s[None, :], between, out=np.zeros_like(between), where=between > 0)
    np.fill_diagonal(ratio, 0.0)
    wcss, bcss = sum(x["w"] for x in spread), float((n * ((mean - middle) ** 2).sum(axis=1)).sum())
    k, total = len(n), int(n.sum())
    got["silhouette"] = sum(x["sil"] for x in pairs) / total
    got["davies_bouldin"] = float(ratio.max(axis=1).mean())
    got["calinski_harabasz"] = 1.0 if wcss == 0 or k == total else (bcss / (k - 1)) / (wcss / (total - k))
    got["min_cluster_size"], got["max_cluster_size"] = int(n.min()), int(n.max())
    got["cluster_size_std"], got["cluster_balance"] = float(n.std()), float(n.min() / n.max())
    apart = [int(m) * (int(m) - 1) // 2 - x["z"] // 2 for m, x in zip(n, pairs)]
    inner = [x["d"] / 2 / c for x, c in zip(pairs, apart) if c > 0]
    if inner:
        got["avg_intra_cluster_distance"], got["std_intra_cluster_distance"] = float(np.mean(inner)), float(np.std(inner))
    if centers:
        c = np.array(centers, dtype=np.float64)
        gaps = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))[np.triu_indices(len(c), 1)]
        gaps = gaps[gaps > 0]
        if len(gaps):
            got["avg_inter_cluster_distance"], got["min_inter_cluster_distance"] = float(gaps.mean()), float(gaps.min())
        if with_sums:
            c, tss = np.array(given, dtype=np.float64), sum(x["t"] for x in spread)
            got["wcss"] = got["inertia"] = sum(x["g"] for x in spread)
            got["bcss"], got["tss"] = float((n * ((c - middle) ** 2).sum(axis=1)).sum()), tss
            got["explained_variance_ratio"] = got["bcss"] / tss if tss > 0 else None
    return tuple(got.get(m) for m in METRICS)
