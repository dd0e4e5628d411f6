"""Metrics of several labelings come from one walk over the pairs of rows, with the values of each by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import evaluate as ev
from pricelens.operators import pairwise as pw
from pricelens.plans import q_eval, q_files


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


@pytest.fixture(scope="module")
def tables(spark):
    """Vectors and three labelings: an id that comes twice on both sides, ids with two labels, a null label, a
    cluster of one row, ids that only one side has."""
    x = np.random.default_rng(5).integers(0, 9, size=(90, 3)).astype(float).tolist()
    vec = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(7, x[7]), (8, [1.0, 2.0, 3.0])], "entity long, features array<double>")
    rows = [(0, i, i % 4) for i in range(95)] + [(0, 7, 3), (0, 9, 0)]
    rows += [(1, i, None if i % 10 == 0 else 5 if i == 3 else i % 2) for i in range(90)] + [(2, i, i % 3) for i in range(40)]
    return vec, spark.createDataFrame(rows, "run int, entity long, cluster int").persist()


def test_one_walk_gives_what_each_labeling_gives(tables):
    vec, long = tables
    got = ev.pair_metrics(vec, long, block_rows=20)
    again = ev.pair_metrics(vec, long, again=True, block_rows=20)
    for r in range(2):
        lb = long.where(F.col("run") == r).select("entity", "cluster")
        assert same(got[r]["silhouette"], ev.silhouette(vec, lb).first()[0]), r
        want = ev.evaluate(vec, lb).first().asDict()
        mine = ev.evaluate(vec, lb, pairs=again[r]).first().asDict()
        assert set(want) == set(mine)
        for m, x in want.items():
            assert same(mine[m], x), (r, m, mine[m], x)
        assert ev.metrics_table(vec, lb, pairs=got[r]).first()["silhouette"] == got[r]["silhouette"]


def test_no_labels(tables):
    vec, long = tables
    assert ev.pair_metrics(vec, long.where("cluster is null")) == {}


@pytest.mark.parametrize("query", [q_eval.e9, q_files.s9])
def test_queries_walk_once(spark, monkeypatch, query):
    walks = []
    real = pw.tiles
    monkeypatch.setattr(pw, "tiles", lambda blocks: walks.append(1) or real(blocks))
    out = query(spark, "/root/testdata/sf0.001")
    assert len(walks) == 1
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in text and out.count() > 0  # reading the result does not walk again


def test_pieces_are_the_plain_distances():
    x = np.random.default_rng(3).normal(size=(pw.PIECE + 37, 5))
    y = x[:300]
    got = np.zeros((len(x), len(y)))
    for i, j, d in pw._distance_pieces(x, y, False):
        got[i, j] = d
    assert np.allclose(got, np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), atol=1e-6)
