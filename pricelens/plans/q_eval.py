"""Registered evaluation queries on matrix M (embeddings) with given labels
(J6, E1-E10, A14, R9)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import pairwise as pw
from ..operators import setops as so
from ..operators import summary as sm
from ..session import checkpoint
from ..sources import tables as tb
from .registry import query, r4

E = "(SELECT vec_id AS entity, CAST(embedding AS DOUBLE[]) AS f, {rule} AS cluster FROM embeddings)"
EL = E.format(rule="label")


def _lf(e: str) -> str:
    return f"(SELECT entity, cluster, generate_subscripts(f, 1) AS i, unnest(f) AS v FROM {e})"


def _sums_sql(e: str) -> str:
    return f"""(SELECT a.entity, a.cluster, b.cluster AS other, sum(list_distance(a.f, b.f)) AS dsum, count(*) AS cnt
        FROM {e} a JOIN {e} b ON a.entity <> b.entity GROUP BY ALL)"""


def _samples_sql(e: str) -> str:
    return f"""(WITH d AS {_sums_sql(e)},
      own AS (SELECT entity, cluster, dsum / cnt AS a FROM d WHERE cluster = other),
      oth AS (SELECT entity, min(dsum / cnt) AS b FROM d WHERE cluster <> other GROUP BY entity)
    SELECT e.entity, e.cluster, CASE WHEN own.a IS NULL OR oth.b IS NULL THEN 0.0
      ELSE coalesce((oth.b - own.a) / nullif(greatest(own.a, oth.b), 0), 0.0) END AS silhouette
    FROM {e} e LEFT JOIN own USING (entity, cluster) LEFT JOIN oth USING (entity))"""


def _cent_sql(e: str) -> str:
    return f"(SELECT cluster, i, avg(v) AS c, count(*) AS n FROM {_lf(e)} GROUP BY cluster, i)"


def _db_sql(e: str) -> str:
    return f"""(WITH c AS {_cent_sql(e)},
      s AS (SELECT cluster, avg(dd) AS s FROM (SELECT l.entity, l.cluster, sqrt(sum((l.v - c.c) ^ 2)) AS dd
            FROM {_lf(e)} l JOIN c USING (cluster, i) GROUP BY l.entity, l.cluster) GROUP BY cluster),
      p AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum((a.c - b.c) ^ 2)) AS d FROM c a JOIN c b USING (i)
            WHERE a.cluster <> b.cluster GROUP BY ALL),
      r AS (SELECT ci, max(CASE WHEN d = 0 THEN 0.0 ELSE (si.s + sj.s) / d END) AS m FROM p
            JOIN s si ON si.cluster = ci JOIN s sj ON sj.cluster = cj GROUP BY ci)
    SELECT avg(m) AS davies_bouldin FROM r)"""


def _var_sql(e: str) -> str:
    return f"""(WITH l AS {_lf(e)}, c AS {_cent_sql(e)},
      o AS (SELECT i, avg(v) AS o FROM l GROUP BY i),
      sz AS (SELECT cluster, count(*) AS n FROM {e} GROUP BY cluster),
      w AS (SELECT sum((l.v - c.c) ^ 2) AS wcss FROM l JOIN c USING (cluster, i)),
      t AS (SELECT sum((l.v - o.o) ^ 2) AS tss FROM l JOIN o USING (i)),
      b AS (SELECT sum(sz.n * (c.c - o.o) ^ 2) AS bcss FROM c JOIN o USING (i) JOIN sz USING (cluster))
    SELECT wcss, bcss, tss, CASE WHEN tss > 0 THEN bcss / tss END AS explained_variance_ratio FROM w, b, t)"""


def _ch_sql(e: str) -> str:
    return f"""(SELECT CASE WHEN wcss = 0 THEN 1.0 ELSE (bcss / (kc - 1)) / (wcss / (n - kc)) END AS calinski_harabasz
      FROM {_var_sql(e)}, (SELECT count(DISTINCT cluster) AS kc, count(*) AS n FROM {e}))"""


def _m(spark, sf):
    return tb.matrix_m(spark, sf)


def _lb(spark, sf, rule="label"):
    return tb.labels_m(spark, sf, rule)


@query("j6_pairwise_sums", f"SELECT entity, cluster, other, round(dsum, 4) AS dsum, cnt FROM {_sums_sql(EL)}")
def j6(spark, sf):
    lv = ev.labeled(_m(spark, sf), _lb(spark, sf))
    s = pw.cluster_distance_sums(lv, block_rows=128)
    return s.where(F.col("cnt") > 0).select("entity", "cluster", "other", r4("dsum").alias("dsum"), "cnt")


@query("e1_silhouette_samples", f"SELECT entity, cluster, round(silhouette, 4) AS silhouette FROM {_samples_sql(EL)}")
def e1s(spark, sf):
    s = ev.silhouette_samples(_m(spark, sf), _lb(spark, sf), block_rows=128)
    return s.select("entity", "cluster", r4("silhouette").alias("silhouette"))


@query("e1_silhouette", f"SELECT round(avg(silhouette), 4) AS silhouette FROM {_samples_sql(E.format(rule='label % 3'))}")
def e1(spark, sf):
    return ev.silhouette(_m(spark, sf), _lb(spark, sf, "label_mod3")).select(r4("silhouette").alias("silhouette"))


@query("e2_davies_bouldin", f"SELECT round(davies_bouldin, 4) AS davies_bouldin FROM {_db_sql(EL)}")
def e2(spark, sf):
    return ev.davies_bouldin(_m(spark, sf), _lb(spark, sf)).select(r4("davies_bouldin").alias("davies_bouldin"))


@query("e3_calinski_harabasz", f"SELECT round(calinski_harabasz, 4) AS calinski_harabasz FROM {_ch_sql(EL)}")
def e3(spark, sf):
    return ev.calinski_harabasz(_m(spark, sf), _lb(spark, sf)).select(r4("calinski_harabasz").alias("calinski_harabasz"))


@query("e4_size_balance", f"""
SELECT min(n) AS min_cluster_size, max(n) AS max_cluster_size, round(stddev_pop(n), 6) AS cluster_size_std,
       round(min(n) / max(n), 6) AS cluster_balance
FROM (SELECT cluster, count(*) AS n FROM {EL} GROUP BY cluster)""")
def e4(spark, sf):
    s = ev.size_balance(_lb(spark, sf))
    return s.select("min_cluster_size", "max_cluster_size", _r6("cluster_size_std"), _r6("cluster_balance"))


def _r6(c):
    from .registry import r6

    return r6(c).alias(c)


@query("e5_intra_distance", f"""
WITH p AS (SELECT a.cluster, list_distance(a.f, b.f) AS d FROM {EL} a JOIN {EL} b
           ON a.cluster = b.cluster AND a.entity < b.entity),
m AS (SELECT cluster, avg(d) AS m FROM p WHERE d > 0 GROUP BY cluster)
SELECT round(avg(m), 4) AS avg_intra_cluster_distance, round(stddev_pop(m), 4) AS std_intra_cluster_distance FROM m""")
def e5(spark, sf):
    r = ev.intra_distance(_m(spark, sf), _lb(spark, sf), block_rows=128)
    return r.select(*[r4(c).alias(c) for c in r.columns])


@query("e6_inter_distance", f"""
WITH c AS {_cent_sql(EL)},
p AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum((a.c - b.c) ^ 2)) AS d FROM c a JOIN c b USING (i)
      WHERE a.cluster < b.cluster GROUP BY ALL)
SELECT round(avg(d), 4) AS avg_inter_cluster_distance, round(min(d), 4) AS min_inter_cluster_distance FROM p WHERE d > 0""")
def e6(spark, sf):
    lv = ev.labeled(_m(spark, sf), _lb(spark, sf))
    cent = ev.centroids(lv, ev.vector_dim(lv))
    r = ev.inter_distance(cent)
    return r.select(*[r4(c).alias(c) for c in r.columns])


@query("e7_variance_split", f"""
SELECT round(wcss, 4) AS wcss, round(bcss, 4) AS bcss, round(tss, 4) AS tss,
       round(explained_variance_ratio, 6) AS explained_variance_ratio FROM {_var_sql(EL)}""")
def e7(spark, sf):
    r = ev.variance_split(_m(spark, sf), _lb(spark, sf))
    return r.select(r4("wcss").alias("wcss"), r4("bcss").alias("bcss"), r4("tss").alias("tss"), _r6("explained_variance_ratio"))


@query("e8_silhouette_by_cluster", f"""
WITH s AS (SELECT entity, cluster, round(silhouette, 4) AS silhouette FROM {_samples_sql(EL)}),
o AS (SELECT avg(silhouette) AS o FROM s)
SELECT cluster, round(avg(silhouette), 4) AS mean, round(stddev_pop(silhouette), 4) AS std, min(silhouette) AS min,
       max(silhouette) AS max, count(*) AS size, count(*) FILTER (WHERE silhouette < o) AS below_overall,
       avg(silhouette) > any_value(o) AS above_average
FROM s, o GROUP BY cluster""")
def e8(spark, sf):
    s = ev.silhouette_samples(_m(spark, sf), _lb(spark, sf), block_rows=128).withColumn("silhouette", r4("silhouette"))
    r = ev.silhouette_by_cluster(s)
    return r.select("cluster", r4("mean").alias("mean"), r4("std").alias("std"), "min", "max", "size", "below_overall", "above_average")


_RULES = {"label": "label", "label_mod3": "label % 3", "id_mod4": "CAST(vec_id % 4 AS INTEGER)"}


def _metrics_rows_sql():
    parts = []
    for i, (name, rule) in enumerate(_RULES.items()):
        e = E.format(rule=rule)
        parts.append(f"""SELECT '{name}' AS algorithm, {i} AS run,
          (SELECT count(DISTINCT cluster) FROM {e}) AS k,
          (SELECT round(avg(silhouette), 4) FROM {_samples_sql(e)}) AS silhouette,
          (SELECT round(davies_bouldin, 4) FROM {_db_sql(e)}) AS davies_bouldin,
          (SELECT round(calinski_harabasz, 4) FROM {_ch_sql(e)}) AS calinski_harabasz""")
    return "(" + " UNION ALL ".join(parts) + ")"


def _labelings(spark, sf):
    """(run, entity, cluster) of all labelings."""
    each = [_lb(spark, sf, name).select(F.lit(i).alias("run"), "entity", "cluster") for i, name in enumerate(_RULES)]
    return functools.reduce(DataFrame.unionByName, each)


def _metrics_rows(spark, sf):
    """Core metrics of every labeling: one walk over the pairs of rows for all, and the few rows are kept, so
    that what reads them several times does not walk again."""
    rows = None
    pairs = ev.pair_metrics(_m(spark, sf), _labelings(spark, sf))
    for i, name in enumerate(_RULES):
        lb = _lb(spark, sf, name)
        m = ev.metrics_table(_m(spark, sf), lb, pairs=pairs.get(i, {"silhouette": None}))
        kk = lb.agg(F.count_distinct("cluster").alias("k"))
        one = m.withColumn("_k", F.lit(0)).join(kk.withColumn("_k", F.lit(0)), "_k").select(
            F.lit(name).alias("algorithm"), F.lit(i).alias("run"), "k",
            r4("silhouette").alias("silhouette"), r4("davies_bouldin").alias("davies_bouldin"),
            r4("calinski_harabasz").alias("calinski_harabasz"))
        rows = one if rows is None else rows.unionByName(one)
    return checkpoint(rows)


@query("a14_best_config", f"""
WITH m AS {_metrics_rows_sql()}
SELECT 'silhouette' AS metric, arg_max(algorithm, struct_pack(v := silhouette, o := -run)) AS algorithm,
       arg_max(k, struct_pack(v := silhouette, o := -run)) AS k, max(silhouette) AS value FROM m
UNION ALL SELECT 'davies_bouldin', arg_max(algorithm, struct_pack(v := -davies_bouldin, o := -run)),
       arg_max(k, struct_pack(v := -davies_bouldin, o := -run)), min(davies_bouldin) FROM m
UNION ALL SELECT 'calinski_harabasz', arg_max(algorithm, struct_pack(v := calinski_harabasz, o := -run)),
       arg_max(k, struct_pack(v := calinski_harabasz, o := -run)), max(calinski_harabasz) FROM m""")
def a14(spark, sf):
    return sm.best_config(_metrics_rows(spark, sf))


@query("e9_compare_runs", f"""
WITH m AS {_metrics_rows_sql()},
l AS (SELECT run, 'silhouette' AS metric, silhouette AS value FROM m
      UNION ALL SELECT run, 'davies_bouldin', davies_bouldin FROM m
      UNION ALL SELECT run, 'calinski_harabasz', calinski_harabasz FROM m)
SELECT run, metric, value, row_number() OVER (PARTITION BY metric ORDER BY
       CASE WHEN metric = 'davies_bouldin' THEN value ELSE -value END, run) AS rank FROM l""")
def e9(spark, sf):
    m = _metrics_rows(spark, sf)
    long = m.select("run", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")
    ])).alias("x")).select("run", "x.metric", "x.value")
    ranks, _ = ev.compare_runs(long)
    return ranks


@query("e9_compare_summary", f"""
WITH m AS {_metrics_rows_sql()},
l AS (SELECT run, 'silhouette' AS metric, silhouette AS value FROM m
      UNION ALL SELECT run, 'davies_bouldin', davies_bouldin FROM m
      UNION ALL SELECT run, 'calinski_harabasz', calinski_harabasz FROM m)
SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max
FROM l GROUP BY metric""")
def e9s(spark, sf):
    m = _metrics_rows(spark, sf)
    long = m.select("run", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")
    ])).alias("x")).select("run", "x.metric", "x.value")
    _, summary = ev.compare_runs(long)
    return summary.select("metric", r4("mean").alias("mean"), r4("std").alias("std"), "min", "max")


@query("e10_adjusted_rand", f"""
WITH j AS (SELECT label AS u, CAST(vec_id % 4 AS INTEGER) AS v FROM embeddings),
c AS (SELECT u, v, count(*) AS nij FROM j GROUP BY u, v),
a AS (SELECT sum(a * (a - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS a FROM c GROUP BY u)),
b AS (SELECT sum(b * (b - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS b FROM c GROUP BY v)),
t AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c)
SELECT round(CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0
  ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END, 6) AS ari FROM a, b, t""")
def e10a(spark, sf):
    from .registry import r6

    r = ev.adjusted_rand(_lb(spark, sf, "label"), _lb(spark, sf, "id_mod4"))
    return r.select(r6("ari").alias("ari"))


# Run r leaves out the vectors whose id is r modulo 7 and moves every (r + 3)-rd one to another cluster.
_RUNS_SQL = """SELECT r, vec_id AS e, CAST(CASE WHEN vec_id % (r + 3) = 0 THEN (label + r) % 4 ELSE label % 4 END AS INTEGER) AS c
FROM embeddings, range(6) g(r) WHERE vec_id % 7 <> r"""


@query("e10_pairwise_ari", f"""
WITH l AS ({_RUNS_SQL}),
c AS (SELECT a.r AS i, b.r AS j, a.c AS u, b.c AS v, count(*) AS nij FROM l a JOIN l b ON a.e = b.e AND a.r < b.r GROUP BY ALL),
a AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS sa FROM (SELECT i, j, u, sum(nij) AS n FROM c GROUP BY ALL) GROUP BY i, j),
b AS (SELECT i, j, sum(n * (n - 1) / 2.0) AS sb FROM (SELECT i, j, v, sum(nij) AS n FROM c GROUP BY ALL) GROUP BY i, j),
t AS (SELECT i, j, sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM c GROUP BY i, j)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round((sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari
FROM t JOIN a USING (i, j) JOIN b USING (i, j)""")
def e10p(spark, sf):
    """ARI of every two of six given labelings of overlapping samples."""
    from .registry import r6

    e = tb.table(spark, sf, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("run")).where("vec_id % 7 <> run")
    moved = F.when(F.col("vec_id") % (F.col("run") + 3) == 0, (F.col("label") + F.col("run")) % 4).otherwise(F.col("label") % 4)
    r = ev.pairwise_ari(e.select("run", F.col("vec_id").alias("entity"), moved.cast("int").alias("cluster")))
    return r.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("ari").alias("ari"))


@query("r9_city_silhouettes", f"""
WITH s AS {_samples_sql(EL)}
SELECT entity, cluster, round(silhouette, 4) AS silhouette, row_number() OVER (ORDER BY silhouette DESC, entity) AS rank,
       (SELECT round(avg(silhouette), 4) FROM {_samples_sql(EL)}) AS overall,
       (SELECT round(davies_bouldin, 4) FROM {_db_sql(EL)}) AS davies_bouldin FROM s""")
def r9(spark, sf):
    from ..operators.report import city_silhouettes

    r = city_silhouettes(_m(spark, sf), _lb(spark, sf), block_rows=128)
    return r.select("entity", "cluster", r4("silhouette").alias("silhouette"), "rank", r4("overall").alias("overall"),
                    r4("davies_bouldin").alias("davies_bouldin"))
