"""Spark ML keeps the points of a fit itself, unless the table given to it is persisted."""

import numpy as np

from pricelens.operators import cluster as cl


def test_fits_do_not_read_a_persisted_table(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    levels, real = [], KMeans.fit

    def fit(self, points):
        levels.append(points.storageLevel)
        return real(self, points)

    monkeypatch.setattr(KMeans, "fit", fit)
    x = np.concatenate([np.random.default_rng(c).normal(size=(30, 3)) + 20 * c for c in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, features array<double>")
    res = cl.kmeans(df, 3, n_init=2, seed=1)
    assert len(levels) == 2 and not any(s.useMemory or s.useDisk for s in levels)
    centers = np.array([r["center"] for r in res.centers.orderBy("cluster").collect()])
    assert np.allclose(centers, x.reshape(3, 30, 3).mean(axis=1))
