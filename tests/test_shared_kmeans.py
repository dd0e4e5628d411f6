"""k-means fits that share their passes end where Spark ML's own fits end."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pricelens.operators import cluster as cl


@pytest.fixture(scope="module")
def vec(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 5)) + r.integers(0, 3, size=(400, 1)) * 2.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, [1.0] * 5) for i in range(20)]
    return spark.createDataFrame(rows, "entity long, features array<double>").persist()


@pytest.mark.parametrize("leading", [False, True])
def test_fits_end_where_spark_ml_ends(vec, leading, monkeypatch):
    ks, n_init, passes, real = [2, 3, 5], 3, [], cl._lloyd_pass
    monkeypatch.setattr(cl, "PACK_ROWS", 64)  # several blocks
    monkeypatch.setattr(cl, "_lloyd_pass", lambda packed, fits, d: passes.append(len(fits)) or real(packed, fits, d))
    data = cl.prepare(vec)
    got = cl.kmeans_many(vec, ks, n_init=n_init, seed=7, data=data, leading=leading)
    steps = []
    for k in ks:
        own = data[0].select("entity", (F.slice("features", 1, k) if leading else F.col("features")).alias("features"))
        spread = np.var(np.array([r["features"] for r in own.collect()]), axis=0).mean()
        points = own.select("entity", array_to_vector("features").alias("features"))
        fits = [KMeans(k=k, seed=7 + r, maxIter=300, tol=(1e-4 * spread / k) ** 0.5).fit(points) for r in range(n_init)]
        cost, r = min((m.summary.trainingCost, r) for r, m in enumerate(fits))
        steps += [m.summary.numIter for m in fits]
        centers = np.vstack(fits[r].clusterCenters())
        centers = centers[cl.canonical_order(centers)]
        assert np.isclose(got[k].info["inertia"], cost) and got[k].info["n_iter"] == fits[r].summary.numIter
        assert np.allclose([c["center"] for c in got[k].centers.orderBy("cluster").collect()], centers)
        want = {e["entity"]: e["cluster"] for e in cl.assign_array(own, centers).collect()}
        assert {e["entity"]: e["cluster"] for e in got[k].labels.collect()} == want
    assert passes[0] == len(ks) * n_init and len(passes) == max(steps) and sum(passes) == sum(steps)


def test_few_distinct_rows_and_a_pass_limit(spark, vec):
    twins = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(12)], "entity long, features array<double>")
    got = cl.kmeans_many(twins, [2, 4], n_init=2)
    assert all(res.centers.count() == 2 and res.info["inertia"] == 0.0 and res.info["converged"] for res in got.values())
    one = cl.kmeans(vec, 3, n_init=1, max_iter=1)
    assert one.info["n_iter"] == 1 and not one.info["converged"]
