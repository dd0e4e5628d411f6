"""The sweep: fits that share their work, and all metrics of all runs from the same jobs."""

import functools
import math

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricelens.operators import cluster as cl
from pricelens.operators import evaluate as ev
from pricelens.operators import spectral as sp
from tests.compare import assert_same
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def vec(spark):
    rows = [(f"city {i}", [float(i % 4) * 5 + (i * 37 % 11) * 0.1, float(i % 7), 1.0]) for i in range(120)]
    rows += [(f"twin {i}", [1.0, 2.0, 3.0]) for i in range(5)]  # rows at distance 0 from each other
    return spark.createDataFrame(rows, "entity string, features array<double>").persist()


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7))


def test_all_runs_equal_each_run(vec):
    by = lambda e: vec.select("entity", e.cast("int").alias("cluster"))
    h = F.xxhash64("entity")
    alone = vec.agg(F.min("entity")).first()[0]
    labelings = {3: by(F.pmod(h, F.lit(3))), 4: by(F.when(F.col("entity") == alone, 9).otherwise(F.pmod(h, F.lit(2)))),  # a cluster of one row
                 7: by(F.lit(0)), 9: by(F.pmod(h, F.lit(5))).where(~F.col("entity").startswith("twin"))}  # one cluster; rows left out
    long = functools.reduce(DataFrame.unionByName, [lb.withColumn("run", F.lit(r)) for r, lb in labelings.items()])
    centers = {r: ev.centroids(ev.labeled(vec, labelings[r]), 3).select("cluster", F.transform("center", lambda x: x + 0.25).alias("center")) for r in (3, 9)}
    given = functools.reduce(DataFrame.unionByName, [c.withColumn("run", F.lit(r)) for r, c in centers.items()])
    got = {r["run"]: r for r in ev.evaluate_runs(vec, long, given, with_sums=[3], block_rows=32).collect()}
    assert set(got) == {3, 4, 9}
    for r, row in got.items():
        want = ev.evaluate(vec, labelings[r], "kmeans" if r == 3 else "fcm", centers.get(r)).first()
        for m in ev.METRICS:
            assert same(row[m], want[m]), (r, m, row[m], want[m])


def test_no_labels_give_no_rows(vec):
    none = vec.selectExpr("1 as run", "entity", "cast(null as int) as cluster")
    assert ev.evaluate_runs(vec, none).collect() == []


def test_shared_fits_equal_single_ones(vec):
    data = cl.prepare(vec)
    many = cl.fcm_many(vec, [2, 4], data=data)
    one = cl.fcm(vec, 4, data=data)
    assert one.centers.orderBy("cluster").collect() == many[4].centers.orderBy("cluster").collect()
    assert one.info["n_iter"] == many[4].info["n_iter"] and one.info["fpc"] == many[4].info["fpc"]
    many = sp.spectral_many(vec, [2, 4], gamma=0.1, n_init=2, data=data)
    one = sp.spectral(vec, 4, gamma=0.1, n_init=2, data=data)
    assert ev.adjusted_rand(one.labels, many[4].labels).first()["ari"] == 1.0
    assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(one.info["eigenvalues"], many[4].info["eigenvalues"]))


def test_sweep_keeps_failed_runs(vec):
    few = vec.where(F.col("entity").isin([f"city {i}" for i in range(6)]))
    got = cl.sweep(few, ("kmeans", "fcm", "none"), ks=(2, 3, 6), params={"fcm": {"max_iter": 20}}, parallel=2).collect()
    rows = {(r["algorithm"], r["k"]): r for r in got}
    assert [r["run"] for r in sorted(got, key=lambda r: r["run"])] == list(range(9))
    for a in ("kmeans", "fcm"):
        assert "must be smaller" in rows[a, 6]["error"] and rows[a, 6]["silhouette"] is None
        assert rows[a, 2]["error"] is None and rows[a, 2]["silhouette"] is not None
    assert (rows["kmeans", 3]["wcss"] is None, rows["fcm", 3]["wcss"] is None) == (False, True)
    assert all("unknown algorithm" in rows["none", k]["error"] for k in (2, 3, 6))


@pytest.mark.parametrize("name", ["c2_fcm", "c6_sweep", "c7_compare", "c7_planted_labels", "c4_spectral_knn_planted"])
def test_query_matches_oracle(spark, duck, name):
    assert_same(entry.queries()[name](spark, SF_SMALL).toPandas(), duck.sql(entry.oracle_sql()[name]).df())
