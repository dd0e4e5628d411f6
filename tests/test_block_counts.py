"""The copies of a row that the tile engine sends around stay bounded while the table grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import evaluate as ev
from pricelens.operators import pairwise as pw
from pricelens.operators import spectral as sp


def _rows(spark, n, d=4):
    x = np.random.default_rng(2).normal(size=(n, d))
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "entity long, cluster int, features array<double>"), x


def test_small_blocks_do_not_multiply_with_the_rows(spark):
    df, _ = _rows(spark, 4000)
    assert pw.n_blocks(df, 128) == pw.MAX_BLOCKS
    assert pw.n_blocks(df.limit(500), 128) == 4


def test_blocks_of_a_group_do_not_multiply_with_its_rows(spark, monkeypatch):
    df, x = _rows(spark, 900)
    seen = []
    real = pw.tiles
    monkeypatch.setattr(pw, "tiles", lambda blocks: seen.append(blocks.agg(F.max("nb")).first()[0]) or real(blocks))
    got = {r["cluster"]: r["dsum"] for r in pw.intra_pair_sums(df, block_rows=7).collect()}
    assert seen == [pw.MAX_BLOCKS]
    for c in range(3):
        y = x[c::3]
        want = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))[np.triu_indices(len(y), 1)].sum()
        assert got[c] == pytest.approx(want)


def test_sums_over_capped_blocks_are_those_of_all_pairs(spark):
    df, x = _rows(spark, 700)
    got = {r["entity"]: r["a"] for r in ev.silhouette_samples(df.select("entity", "features"), df.select("entity", "cluster"), block_rows=5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(0, 700, 50):
        own = [j for j in range(700) if j % 3 == i % 3 and j != i]
        assert got[i] == pytest.approx(d[i, own].mean())


def test_cells_travel_in_groups(spark):
    df, _ = _rows(spark, 600)
    rows, _ = sp.knn_tiles(df.select("entity", "features"), 5, pivots=100, block_rows=4)
    assert rows.select("cell").distinct().count() > 2 * pw.MAX_BLOCKS
    assert rows.groupBy("grp").agg(F.max("_nb").alias("n")).agg(F.sum("n")).first()[0] <= 2 * pw.MAX_BLOCKS + 1
