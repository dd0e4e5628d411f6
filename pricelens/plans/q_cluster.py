"""Registered clustering queries on matrix M."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cluster as cl
from ..operators import evaluate as ev
from ..operators import pairwise as pw
from ..operators import report as rp
from ..operators import spectral as sp
from ..sources import tables as tb
from .q_eval import EL, _ch_sql, _db_sql, _lf, _samples_sql, _var_sql
from .registry import SQL, query, r4, r6


def _m(spark, sf):
    return tb.matrix_m(spark, sf)


def _fit_facts(vec, res):
    """Facts that hold for any correct fit by nearest centers, as one row:
    rows, labeled entities, clusters, rows not at their nearest center, whether
    each center is the mean of its rows, whether WCSS + BCSS = TSS, TSS."""
    lv = ev.labeled(vec, res.labels).persist()
    dim = ev.vector_dim(lv)
    means = ev.centroids(lv, dim).select("cluster", F.col("center").alias("mean"))
    drift = res.centers.join(means, "cluster").agg(F.max(F.sqrt(ev.sq_dist(F.col("center"), F.col("mean")))).alias("d"))
    near = cl.assign(vec, res).withColumnRenamed("cluster", "near")
    off = lv.join(near, "entity").agg(F.count_if(F.col("near") != F.col("cluster")).alias("misplaced"))
    base = lv.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("cluster").alias("clusters"))
    v = ev.variance_split(vec, res.labels)
    k = F.lit(0)
    one = base.withColumn("_k", k)
    for part in (drift, off, v):
        one = one.join(part.withColumn("_k", k), "_k")
    return one.select("n", "entities", "clusters", "misplaced", (F.col("d") < 0.05).alias("centers_are_means"),
                      (F.abs(F.col("wcss") + F.col("bcss") - F.col("tss")) <= 1e-9 * F.col("tss")).alias("adds_up"),
                      r4("tss").alias("tss"))


def _facts_sql(k: int, of: str = EL) -> str:
    return f"""
SELECT count(*) AS n, count(DISTINCT entity) AS entities, {k} AS clusters, 0 AS misplaced, true AS centers_are_means, true AS adds_up,
       (SELECT round(tss, 4) FROM {_var_sql(of)}) AS tss FROM {of}"""


@query("c1_kmeans", _facts_sql(10))
def c1(spark, sf):
    """10 k-means restarts, k=10: facts of the best fit."""
    m = _m(spark, sf)
    return _fit_facts(m, cl.kmeans(m, 10, n_init=10, max_iter=300, tol=1e-4, seed=42))


@query("c1_kmeans_centers", """
SELECT CAST(i AS INTEGER) AS cluster, (SELECT max(len(embedding)) FROM embeddings) AS dim, true AS ordered, true AS beats_one_cluster
FROM range(4) t(i)""")
def c1c(spark, sf):
    """The centers: one per cluster, full width, in canonical order, and
    together closer to the rows than their common mean is."""
    m = _m(spark, sf)
    res = cl.kmeans(m, 4, n_init=10, seed=7)
    v = ev.variance_split(m, res.labels).select((F.lit(res.info["inertia"]) < F.col("tss")).alias("beats_one_cluster"), F.lit(0).alias("_k"))
    c = res.centers.withColumn("_prev", F.lag("center").over(Window.partitionBy(F.lit(0)).orderBy("cluster")))
    c = c.select("cluster", F.size("center").alias("dim"), F.coalesce(F.col("_prev") <= F.col("center"), F.lit(True)).alias("ordered"), F.lit(0).alias("_k"))
    return c.join(v, "_k").drop("_k")


@query("c1_kmeans_text_ids", f"""
SELECT f.*, true AS names_kept, true AS silhouettes_ok
FROM ({_facts_sql(4)}) f""")
def c1t(spark, sf):
    """Fit and score entities whose ids are names."""
    m = _m(spark, sf).withColumn("entity", F.concat(F.lit("city "), F.col("entity").cast("string")))
    res = cl.kmeans(m, 4, n_init=4, seed=3)
    sil = ev.silhouette_samples(m, res.labels).agg(
        (F.count_if(~F.col("entity").startswith("city ")) == 0).alias("names_kept"),
        (F.count_if(F.col("silhouette").between(-1, 1)) == F.count(F.lit(1))).alias("silhouettes_ok"))
    k = F.lit(0)
    return _fit_facts(m, res).withColumn("_k", k).join(sil.withColumn("_k", k), "_k").drop("_k")


@query("c2_fcm", """
SELECT 4 * count(*) AS rows, count(DISTINCT vec_id) AS entities, 4 AS clusters, true AS sums_to_one, true AS in_range, true AS fpc_ok,
       true AS converged, true AS u_from_distances, true AS centers_are_means FROM embeddings""")
def c2(spark, sf):
    """Fuzzy c-means, k=4, m=2: facts of the memberships (entity, cluster, u), which are computed again from
    the distances to the centers, and the centers from them."""
    m = _m(spark, sf)
    res = cl.fcm(m, 4, m=2.0, error=1e-5, max_iter=150, seed=42)
    near = m.join(res.memberships, "entity").join(F.broadcast(res.centers), "cluster").withColumn("i", 1.0 / ev.sq_dist(F.col("features"), F.col("center")))
    near = near.withColumn("again", F.col("i") / F.sum("i").over(Window.partitionBy("entity")))
    off = near.agg(F.max(F.abs(F.col("u") - F.col("again"))).alias("off"))
    cells = near.select("cluster", F.pow("u", F.lit(2.0)).alias("w"), F.posexplode(F.arrays_zip("features", "center")).alias("j", "x"))
    cells = cells.groupBy("cluster", "j").agg((F.sum(F.col("w") * F.col("x.features")) / F.sum("w") - F.max("x.center")).alias("gap"))
    off = off.withColumn("_k", F.lit(0)).join(cells.agg(F.max(F.abs("gap")).alias("gap"), F.lit(0).alias("_k")), "_k")
    per = res.memberships.groupBy("entity").agg(F.sum("u").alias("s"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.count(F.lit(1)).alias("c"))
    one = per.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("entities"), F.max("c").cast("int").alias("clusters"),
                   (F.max(F.abs(F.col("s") - 1)) < 1e-9).alias("sums_to_one"), ((F.min("lo") >= 0) & (F.max("hi") <= 1)).alias("in_range"),
                   F.lit(bool(0.25 - 1e-9 <= res.info["fpc"] <= 1 + 1e-9)).alias("fpc_ok"), F.lit(res.info["converged"]).alias("converged"), F.lit(0).alias("_k"))
    off = off.select("_k", (F.col("off") < 1e-9).alias("u_from_distances"), (F.col("gap") < 1e-4).alias("centers_are_means"))
    return one.join(off, "_k").drop("_k")


_RBF_SQL = f"""
SELECT a.entity, round(sum(exp(-1.0 * list_distance(a.f, b.f) ^ 2)), 6) AS degree
FROM {EL} a JOIN {EL} b ON a.entity <> b.entity GROUP BY a.entity"""


@query("c3_affinity_rbf_degrees", _RBF_SQL)
def c3(spark, sf):
    d = sp.affinity_degrees(_m(spark, sf), "rbf", gamma=1.0, block_rows=128)
    return d.select("entity", r6("degree").alias("degree"))


@query("c3_affinity_cosine_degrees", f"""
SELECT a.entity, round(sum(list_cosine_similarity(a.f, b.f)), 6) AS degree
FROM {EL} a JOIN {EL} b ON a.entity <> b.entity GROUP BY a.entity""")
def c3c(spark, sf):
    d = sp.affinity_degrees(_m(spark, sf), "cosine", block_rows=128)
    return d.select("entity", r6("degree").alias("degree"))


_DOT = "(0.5 * list_dot_product(a.f, b.f) + 1.0)"
_DEGREE_SQL = f"SELECT a.entity, round(sum({{k}}), 4) AS degree FROM {EL} a JOIN {EL} b ON a.entity <> b.entity GROUP BY a.entity"


@query("c3_affinity_polynomial_degrees", _DEGREE_SQL.format(k=f"{_DOT} ^ 3"))
def c3p(spark, sf):
    d = sp.affinity_degrees(_m(spark, sf), "polynomial", gamma=0.5, degree=3.0, coef0=1.0, block_rows=128)
    return d.select("entity", r4("degree").alias("degree"))


@query("c3_affinity_sigmoid_degrees", _DEGREE_SQL.format(k=f"tanh({_DOT})"))
def c3s(spark, sf):
    d = sp.affinity_degrees(_m(spark, sf), "sigmoid", gamma=0.5, coef0=1.0, block_rows=128)
    return d.select("entity", r4("degree").alias("degree"))


@query("c3_affinity_callable_degrees", _DEGREE_SQL.format(k="1 / (1 + list_distance(a.f, b.f))"))
def c3f(spark, sf):
    """A kernel of the caller's own: 1 / (1 + distance)."""
    d = sp.affinity_degrees(_m(spark, sf), lambda x, y: 1.0 / (1.0 + pw.sq_dists(x, y) ** 0.5), block_rows=128)
    return d.select("entity", r4("degree").alias("degree"))


@query("c3_affinity_knn_graph", f"""
WITH d AS (SELECT a.entity AS a, b.entity AS b, list_distance(a.f, b.f) ^ 2 AS d2 FROM {EL} a, {EL} b),
nn AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM d) WHERE r <= 10),
e AS (SELECT a, b, 0.5 AS w FROM nn UNION ALL SELECT b, a, 0.5 FROM nn)
SELECT a, b, sum(w) AS w FROM e GROUP BY a, b""")
def c3k(spark, sf):
    return sp.knn_graph(_m(spark, sf), 10, block_rows=128)


_SPECTRAL_SQL = "SELECT count(*) AS n, count(DISTINCT vec_id) AS entities, 4 AS clusters, 1.0 AS top_eigenvalue, true AS eigenvalues_ok FROM embeddings"


def _spectral_facts(res):
    """Rows, entities, clusters; the normalised affinity has top eigenvalue 1
    and none outside [-1, 1]."""
    e = res.info["eigenvalues"]
    return res.labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("cluster").alias("clusters"),
                          r6(F.lit(float(e[0])), 3).alias("top_eigenvalue"),
                          F.lit(all(-1 - 1e-6 <= x <= 1 + 1e-6 for x in e) and e == sorted(e, reverse=True)).alias("eigenvalues_ok"))


@query("c4_spectral", _SPECTRAL_SQL)
def c4(spark, sf):
    """Spectral clustering (rbf, gamma=1, k=4): subspace iteration + k-means."""
    return _spectral_facts(sp.spectral(_m(spark, sf), 4, affinity="rbf", gamma=1.0, n_init=10, seed=42, block_rows=256))


@query("c4_spectral_knn", _SPECTRAL_SQL)
def c4k(spark, sf):
    return _spectral_facts(sp.spectral(_m(spark, sf), 4, affinity="nearest_neighbors", n_neighbors=10, n_init=10, seed=42, block_rows=256))


def _planted(spark, sf, groups):
    """Matrix M with its given labels, taken by ``groups``, as far-apart blobs: (entity, features)."""
    e = tb.table(spark, sf, "embeddings")
    far = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.when(F.col("label") % groups == i, 10.0).otherwise(0.0))
    near = F.transform("embedding", lambda x: x.cast("double") * 0.1)
    return e.where(F.col("label").isNotNull()).select(F.col("vec_id").alias("entity"), F.concat(far, near).alias("features"))


_PLANTED_SQL = """
SELECT algorithm, vec_id AS entity, min(vec_id) OVER w AS first, count(*) OVER w AS size
FROM (SELECT algorithm, vec_id, label % g AS part FROM embeddings, (VALUES {}) a(algorithm, g) WHERE label IS NOT NULL) WINDOW w AS (PARTITION BY algorithm, part)"""


def _found(labels, name):
    """Every row with the smallest id and the size of its cluster, whatever the cluster's number."""
    of = labels.groupBy("cluster").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("size"))
    return labels.join(F.broadcast(of), "cluster").select(F.lit(name).alias("algorithm"), "entity", "first", "size")


@query("c7_planted_labels", _PLANTED_SQL.format("('kmeans', 3), ('fcm', 3), ('spectral', 3)"))
def c7p(spark, sf):
    """Each algorithm's label of every row, on blobs built from the given labels (modulo 3)."""
    vec = _planted(spark, sf, 3)
    _, fits, _ = cl.compare(vec, cl.ALGORITHMS, 3, params={"spectral": {"block_rows": 256}})
    return functools.reduce(lambda a, b: a.unionByName(b), [_found(res.labels, name) for name, res in fits.items()])


@query("c4_spectral_knn_planted", _PLANTED_SQL.format("('spectral', 10)"))
def c4p(spark, sf):
    """Spectral labels of every row by the k-NN graph, on blobs built from the ten given labels."""
    res = sp.spectral(_planted(spark, sf, 10), 10, affinity="nearest_neighbors", n_neighbors=20, seed=42, block_rows=256)
    return _found(res.labels, "spectral")


@query("c5_assign", f"""
WITH l AS (SELECT entity, i, v FROM {_lf(EL)}),
c AS (SELECT cluster, i, avg(v) AS c FROM {_lf(EL)} GROUP BY cluster, i),
d AS (SELECT l.entity, c.cluster, sum((l.v - c.c) ^ 2) AS d2 FROM l JOIN c USING (i) GROUP BY l.entity, c.cluster)
SELECT entity, arg_min(cluster, d2) AS cluster FROM d GROUP BY entity""")
def c5(spark, sf):
    m = _m(spark, sf)
    lv = ev.labeled(m, tb.labels_m(spark, sf))
    cent = ev.centroids(lv, ev.vector_dim(lv))
    return cl.assign(m, cent.select("cluster", "center"))


def _sane(df, n):
    """Whether a run's metrics are within the bounds that hold for any labeling of ``n`` rows."""
    ok = (F.col("silhouette").between(-1, 1) & (F.col("davies_bouldin") >= 0) & (F.col("calinski_harabasz") >= 0)
          & (F.col("min_cluster_size") >= 1) & (F.col("max_cluster_size") < n) & (F.col("max_cluster_size") * F.col("k") >= n)
          & (F.abs(F.col("cluster_balance") * F.col("max_cluster_size") - F.col("min_cluster_size")) < 1e-6) & (F.col("avg_intra_cluster_distance") > 0))
    fits = (F.col("wcss") <= F.col("tss")) & (F.abs(F.col("explained_variance_ratio") * F.col("tss") - F.col("bcss")) <= 1e-6 * F.col("tss"))
    return ok & F.when(F.col("algorithm") == "kmeans", fits).otherwise(F.col("wcss").isNull())


@query("c6_sweep", f"""
SELECT a AS algorithm, CAST(k AS INTEGER) AS k, CAST(row_number() OVER (ORDER BY o, k) - 1 AS INTEGER) AS run, true AS metrics_ok,
  a <> 'spectral' AS has_centers, CASE WHEN a = 'kmeans' THEN (SELECT round(tss, 4) FROM {_var_sql(EL)}) END AS tss, false AS failed
FROM (VALUES ('kmeans', 0), ('fcm', 1), ('spectral', 2)) t(a, o), range(2, 11) g(k)""")
def c6(spark, sf):
    """Every algorithm x k = 2 to 10 on matrix M, all metrics of every run."""
    m = _m(spark, sf)
    out = cl.sweep(m, params={"spectral": {"block_rows": 256}}, parallel=4)
    return out.select("algorithm", "k", "run", _sane(out, m.count()).alias("metrics_ok"), F.col("min_inter_cluster_distance").isNotNull().alias("has_centers"),
                      r4("tss").alias("tss"), F.col("error").isNotNull().alias("failed"))


@query("c7_compare", """
SELECT a AS algorithm, 3 AS k, true AS metrics_ok, 1 AS best_rows, a = 'none' AS failed
FROM (VALUES ('kmeans'), ('fcm'), ('spectral')) t(a) UNION ALL SELECT 'none', 3, NULL, 1, true""")
def c7(spark, sf):
    """The same k for every algorithm; one that does not exist becomes a failed row."""
    m = _m(spark, sf)
    df, _, best = cl.compare(m, (*cl.ALGORITHMS, "none"), 3, params={"spectral": {"block_rows": 256}})
    # exactly one algorithm is the best, and it has the highest silhouette
    top = df.agg(F.max("silhouette").alias("top"), F.count_if(F.col("algorithm") == F.lit(best)).alias("best_rows"), F.lit(0).alias("_k"))
    j = df.withColumn("_k", F.lit(0)).join(top, "_k")
    ok = _sane(df, m.count()) & ((F.col("algorithm") != F.lit(best)) | (F.col("silhouette") == F.col("top")))
    failed = F.col("error").isNotNull()
    return j.select("algorithm", "k", F.when(~failed, ok).alias("metrics_ok"), "best_rows", failed.alias("failed"))


@query("e10_stability", """
WITH n AS (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL)
SELECT i, j, true AS in_range, CAST(floor(0.8 * n + 0.5) AS BIGINT) AS rows_i, 1.0 AS given
FROM range(10) a(i), range(10) b(j), n WHERE i < j""")
def e10(spark, sf):
    """ARI of 10 k-means fits (k=4) on seeded 80 % subsamples, every pair; the exact sample size; the
    ARI of the given labels on the same samples."""
    m, given = _m(spark, sf), tb.labels_m(spark, sf)
    sizes = []

    def fit(sample, k):
        sizes.append(sample.count())
        return cl.kmeans(sample, k, n_init=10, seed=1).labels

    pairs, _ = ev.stability(m, fit, 4, n=10, ratio=0.8, seed=42)
    same, _ = ev.stability(m, lambda sample, k: sample.join(given, "entity").select("entity", "cluster"), 4, n=10, ratio=0.8, seed=42)
    rows = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("i")).cast("long")
    out = pairs.join(same.withColumnRenamed("ari", "given"), ["i", "j"])
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("ari").between(-1, 1).alias("in_range"), rows.alias("rows_i"), "given")


@query("r11_run_summary", f"""
WITH s AS (SELECT cluster, count(*) AS size FROM {EL} GROUP BY cluster)
SELECT cluster, size, (SELECT count(*) FROM {EL}) AS n, (SELECT count(DISTINCT cluster) FROM {EL}) AS k,
  (SELECT round(avg(silhouette), 4) FROM {_samples_sql(EL)}) AS silhouette,
  (SELECT round(davies_bouldin, 4) FROM {_db_sql(EL)}) AS davies_bouldin,
  (SELECT round(calinski_harabasz, 4) FROM {_ch_sql(EL)}) AS calinski_harabasz FROM s""")
def r11(spark, sf):
    r = rp.run_summary(_m(spark, sf), tb.labels_m(spark, sf))
    return r.select("cluster", "size", "n", "k", r4("silhouette").alias("silhouette"), r4("davies_bouldin").alias("davies_bouldin"),
                    r4("calinski_harabasz").alias("calinski_harabasz"))


@query("r11_run_simple", f"""
SELECT entity, cluster, 'given' AS algorithm, (SELECT count(DISTINCT cluster) FROM {EL}) AS k, count(*) OVER (PARTITION BY cluster) AS size,
  count(*) OVER () AS total FROM {EL}""")
def r11s(spark, sf):
    """The simple form: every assignment with its cluster's size."""
    lb = tb.labels_m(spark, sf)
    who, sizes = rp.run_simple(lb, "given", lb.select("cluster").distinct().count())
    return who.join(sizes.select("cluster", "size", "total"), "cluster").withColumn("k", F.col("k").cast("long"))


_EVAL_SQL = f"""
SELECT {{head}}(SELECT round(avg(silhouette), 4) FROM {_samples_sql(EL)}) AS silhouette,
  (SELECT round(davies_bouldin, 4) FROM {_db_sql(EL)}) AS davies_bouldin, (SELECT round(calinski_harabasz, 4) FROM {_ch_sql(EL)}) AS calinski_harabasz,
  b.*, i.*, d.*, v.wcss AS wcss, v.wcss AS inertia, v.bcss AS bcss, v.tss AS tss, v.explained_variance_ratio AS explained_variance_ratio
FROM ({SQL["e4_size_balance"]}) b, ({SQL["e5_intra_distance"]}) i, ({SQL["e6_inter_distance"]}) d, ({SQL["e7_variance_split"]}) v"""


def _rounded(m):
    six = ("cluster_size_std", "cluster_balance", "explained_variance_ratio")
    return [m[c].alias(c) if c in ev.QUALITY[:2] else (r6 if c in six else r4)(m[c]).alias(c) for c in ev.METRICS]


@query("e_evaluate_all", _EVAL_SQL.format(head=""))
def e_all(spark, sf):
    """Every metric of one labeling in one call, centers = the centroids."""
    m, lb = _m(spark, sf), tb.labels_m(spark, sf)
    lv = ev.labeled(m, lb)
    out = ev.evaluate(m, lb, "kmeans", ev.centroids(lv, ev.vector_dim(lv)))
    return out.select(*_rounded(out))


@query("r11_run_detailed", _EVAL_SQL.format(
    head=f"'kmeans' AS algorithm, CAST((SELECT count(DISTINCT cluster) FROM {EL}) AS INTEGER) AS k, (SELECT count(*) FROM {EL}) AS assigned, "
         f"(SELECT sum(n * n) FROM (SELECT count(*) AS n FROM {EL} GROUP BY cluster)) AS size_squares, "))
def r11d(spark, sf):
    """The detailed form: assignments, metrics and sizes."""
    m, lb = _m(spark, sf), tb.labels_m(spark, sf)
    lv = ev.labeled(m, lb)
    parts = rp.run_detailed(m, lb, "kmeans", lb.select("cluster").distinct().count(), ev.centroids(lv, ev.vector_dim(lv)), 0.5)
    k = F.lit(0).alias("_k")
    who = parts["assignments"].agg(F.count_distinct("entity").alias("assigned")).select("assigned", k)
    sizes = parts["sizes"].agg(F.sum(F.col("size") * F.col("size")).alias("size_squares")).select("size_squares", k)
    metrics = parts["metrics"]
    return metrics.select("algorithm", "k", *_rounded(metrics), k).join(who, "_k").join(sizes, "_k").drop("_k")


_PL = f"(SELECT p.*, l.Cluster FROM ({tb.PANEL_P_SQL}) p JOIN ({tb.LABELS_P_SQL}) l USING (City) WHERE l.Cluster IS NOT NULL)"

# Count and sum of a value of each part; correlations are those of averaged prices on (city, date).
_REPORT_SQL = f"""
WITH pl AS (SELECT *, CAST(year(Date) AS INTEGER) AS Year FROM {_PL}),
items AS (SELECT DISTINCT Commodity FROM pl), years AS (SELECT DISTINCT Year FROM pl), clusters AS (SELECT DISTINCT Cluster FROM pl),
n AS (SELECT (SELECT count(*) FROM items) AS i, (SELECT count(*) FROM years) AS y, (SELECT count(*) FROM clusters) AS c),
ic AS (SELECT Cluster, Commodity, avg(Price) AS m FROM pl GROUP BY ALL),
ir AS (SELECT Commodity, min(m) AS lo, max(m) AS hi FROM ic GROUP BY ALL),
box AS (SELECT Commodity, Year, Cluster, quantile_cont(Price, 0.25) AS q1, quantile_cont(Price, 0.5) AS q2, quantile_cont(Price, 0.75) AS q3 FROM pl GROUP BY ALL),
outl AS (SELECT Price FROM pl JOIN box USING (Commodity, Year, Cluster) WHERE Price < q1 - 1.5 * (q3 - q1) OR Price > q3 + 1.5 * (q3 - q1)),
g AS (SELECT City, Date, Cluster, Commodity, avg(Price) AS x FROM pl WHERE Price IS NOT NULL GROUP BY ALL),
cg AS (SELECT covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS r FROM g a JOIN g b USING (City, Date) GROUP BY a.Commodity, b.Commodity),
cc AS (SELECT covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS r FROM g a JOIN g b USING (City, Date)
       GROUP BY a.Cluster, a.Commodity, b.Commodity)
SELECT 'monthly_trends' AS part, (SELECT count(*) FROM ic) * n.y * 12 AS rows,
  (SELECT round(sum(p), 2) FROM (SELECT avg(Price) AS p FROM pl GROUP BY Commodity, Cluster, year(Date), month(Date))) AS total FROM n
UNION ALL SELECT 'radar', n.c * n.i, (SELECT round(sum(floor(1000 * CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0.5 END + 0.5) / 1000), 1) FROM ic JOIN ir USING (Commodity)) FROM n
UNION ALL SELECT 'boxplot', n.c * n.i * n.y, (SELECT round(sum(q2), 2) FROM box) FROM n
UNION ALL SELECT 'boxplot_outliers', count(*), round(sum(Price), 2) FROM outl HAVING count(*) > 0
UNION ALL SELECT 'correlation', n.i * n.i, (SELECT round(sum(r), 2) FROM cg) FROM n
UNION ALL SELECT 'correlation_per_cluster', n.c * n.i * n.i, (SELECT round(sum(r), 2) FROM cc) FROM n
UNION ALL SELECT 'years', n.y, (SELECT sum(Year) FROM years) FROM n
UNION ALL SELECT 'variance', 2, {{ratio}}"""

#: part -> the value whose sum is reported
_TOTALS = {"monthly_trends": "avg_price", "radar": "value", "boxplot": "median", "boxplot_outliers": "value", "correlation": "r",
           "correlation_per_cluster": "r", "years": "year", "assignments": "clusterId", "silhouettes": "silhouette"}


def _part_totals(parts):
    """(part, rows, total) of a report bundle."""
    rows = []
    for name, df in parts.items():
        digits = 1 if name == "radar" else 2
        total = r6(F.sum(F.col(_TOTALS[name]).cast("double")), digits) if name in _TOTALS else F.lit(0.0)
        rows.append(df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), total.alias("total")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("r12_report", _REPORT_SQL.format(ratio="0.0") + f"""
UNION ALL SELECT 'silhouettes', count(*), round(sum(silhouette), 2) FROM {_samples_sql(EL)}
UNION ALL SELECT 'projection', count(*), 0.0 FROM embeddings
UNION ALL SELECT 'loadings', max(len(embedding)), 0.0 FROM embeddings
UNION ALL SELECT 'assignments', count(*), sum(Cluster) FROM ({tb.LABELS_P_SQL})""")
def r12(spark, sf):
    """The report bundle: rows and the sum of a value of every part."""
    return _part_totals(rp.report(tb.panel_p(spark, sf), _m(spark, sf), tb.labels_p(spark, sf), tb.labels_m(spark, sf), tb.coordinates_p(spark, sf)))


@query("z5_analyze", f"""
WITH p AS MATERIALIZED (SELECT *, CAST(year(Date) AS INTEGER) AS Year FROM ({tb.PANEL_P_SQL})),
n AS (SELECT count(DISTINCT City) AS e, count(DISTINCT Commodity) AS i, count(DISTINCT Year) AS y FROM p),
g AS (SELECT City, Date, Commodity, avg(Price) AS x FROM p WHERE Price IS NOT NULL GROUP BY ALL),
cg AS (SELECT covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS r FROM g a JOIN g b USING (City, Date) GROUP BY a.Commodity, b.Commodity)
SELECT 'assignments' AS part, e AS rows, 0.0 AS total FROM n
UNION ALL SELECT 'boxplot', 3 * i * y, 0.0 FROM n
UNION ALL SELECT 'correlation', i * i, (SELECT round(sum(r), 2) FROM cg) FROM n
UNION ALL SELECT 'correlation_per_cluster', 3 * i * i, 0.0 FROM n
UNION ALL SELECT 'loadings', 3 * i, 0.0 FROM n
UNION ALL SELECT 'monthly_trends', 3 * i * y * 12, 0.0 FROM n
UNION ALL SELECT 'projection', e, 0.0 FROM n
UNION ALL SELECT 'radar', 3 * i, 0.0 FROM n
UNION ALL SELECT 'silhouettes', e, 0.0 FROM n
UNION ALL SELECT 'variance', 2, 0.0 FROM n
UNION ALL SELECT 'years', y, (SELECT CAST(sum(Year) AS DOUBLE) FROM (SELECT DISTINCT Year FROM p)) FROM n
UNION ALL SELECT 'cities of clusters', e, 3.0 FROM n
UNION ALL SELECT 'sane metrics', 1, 1.0""")
def z5(spark, sf):
    """Checks -> k-means fit -> metrics -> report over the panel P feature matrix (cities as entities):
    rows of every part whose size does not depend on the labels found, totals where the values do not."""
    from .pipelines import analyze

    res, metrics, parts = analyze(tb.panel_p(spark, sf), "kmeans", 3, features=("avg", "cv", "trend"), coords=tb.coordinates_p(spark, sf))
    free = {"correlation": "r", "years": "year"}
    rows = []
    for name, df in parts.items():
        if name != "boxplot_outliers":  # there only where some cluster has outliers
            total = r6(F.sum(F.col(free[name]).cast("double")), 2) if name in free else F.lit(0.0)
            rows.append(df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), total.alias("total")))
    rows.append(res.labels.agg(F.lit("cities of clusters").alias("part"), F.count_distinct("City").alias("rows"), F.count_distinct("Cluster").cast("double").alias("total")))
    rows.append(metrics.select(F.lit("sane metrics").alias("part"), F.lit(1).cast("long").alias("rows"), _sane(metrics, res.labels.count()).cast("double").alias("total")))
    return functools.reduce(lambda a, b: a.unionByName(b), rows)
