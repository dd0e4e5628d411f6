"""Faults mended after the first round."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricelens.functions.columns import parse_price
from pricelens.functions.quantiles import exact_quantiles
from pricelens.functions.stats import pearson_p_array
from pricelens.operators import cluster as cl
from pricelens.operators.clean import fill_gaps
from tests.compare import assert_same
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", ["a5_feature_matrix_all", "a6_feature_matrix_yearly", "z4_build_features", "r2_monthly_trends_sparse", "w1_fill_gaps",
                                  "c1_kmeans", "c1_kmeans_text_ids", "c2_fcm", "r7_correlation_pvalues", "r8_project_2d",
                                  "r8_project_2d_variance", "r12_report", "z2_build_panel", "z3_validate_panel", "z5_analyze"])
def test_query_matches_oracle(spark, duck, name):
    duck.sql(f"CREATE OR REPLACE VIEW checked AS {entry.oracle_sql()[name]}")  # a view, as a static query allows
    assert_same(entry.queries()[name](spark, SF_SMALL).toPandas(), duck.sql("SELECT * FROM checked").df())


def test_fill_gaps_with_null_dates_and_keys(spark):
    day = lambda m, d: dt.datetime(2020, m, d)
    rows = [("a", "x", None, 1, None), ("a", "x", None, 2, 5.0), ("a", "x", day(1, 3), 3, None), ("a", "x", day(2, 1), 4, 7.0), ("a", "x", day(3, 1), 5, None),
            (None, "x", day(1, 1), 6, None), (None, "x", day(1, 2), 7, 2.0), ("b", None, None, 8, None)]
    df = spark.createDataFrame(rows, "City string, Commodity string, Date timestamp, n int, Price double")
    order = ["Date", "n"]
    for chunk_rows in (1, 1000):
        got = {r["n"]: r["Price"] for r in fill_gaps(df, order=order, chunk_rows=chunk_rows).collect()}
        assert got == {1: 5.0, 2: 5.0, 3: 5.0, 4: 7.0, 5: 7.0, 6: 2.0, 7: 2.0, 8: None}


def test_panel_prices_keep_no_commas(spark):
    df = spark.createDataFrame([("12,500",), (" 7 ",)], "p string").select(parse_price("p", commas=False).alias("a"), parse_price("p").alias("b"))
    assert [tuple(r) for r in df.collect()] == [(None, 12500.0), (7.0, 7.0)]


@pytest.mark.parametrize("values", [
    [1.0] * 7 + [float("inf")], [float("-inf")] * 3 + [2.0, 5.0, float("inf")], [float("inf")] * 4, [3.0] * 30,
    [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0], list(map(float, range(201))) + [float("inf")],
])
def test_quantiles_of_extreme_values(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    a = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)) for p in probs]).first()
    b = exact_quantiles(df, ["k"], "v", probs, sketch=8).first()
    for x, y in zip(a[1:], b[1:]):
        assert x == y or (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-12)


def test_failing_algorithm_becomes_a_row(spark):
    rows = [(f"city {i}", [float(i % 2) * 10 + i * 0.01, float(i)]) for i in range(12)]
    vec = spark.createDataFrame(rows, "entity string, features array<double>")
    df, results, best = cl.compare(vec, ("kmeans", "fcm"), 2, params={"fcm": {"m": 0.5}})
    got = {r["algorithm"]: r for r in df.collect()}
    assert "ValueError" in got["fcm"]["error"] and got["kmeans"]["error"] is None and best == "kmeans" and set(results) == {"kmeans"}


def test_kmeans_does_not_depend_on_input_partitions(spark):
    vec = spark.createDataFrame([(i, [float(i % 3) * 5, (i * 37 % 11) * 0.1]) for i in range(60)], "entity long, features array<double>")
    a = cl.kmeans(vec.repartition(7), 3, n_init=2).labels.orderBy("entity").collect()
    assert a == cl.kmeans(vec.coalesce(1), 3, n_init=2).labels.orderBy("entity").collect()


def test_pvalues_of_large_samples_follow_the_normal_law():
    import numpy as np

    n = np.array([10**4, 10**6, 10**8])
    got = pearson_p_array(1.959963985 / np.sqrt(n), n)
    assert np.allclose(got, 0.05, atol=2e-5)


def test_spectral_raises_when_not_settled(spark):
    from pricelens.operators.spectral import spectral

    vec = spark.createDataFrame([(i, [float(i % 3) * 5, (i * 37 % 11) * 0.1]) for i in range(40)], "entity long, features array<double>")
    with pytest.raises(RuntimeError, match="not settled"):
        spectral(vec, 3, max_iter=1, block_rows=32)


def test_evaluate_needs_two_clusters_and_leaves_missing_metrics_null(spark):
    from pricelens.operators.evaluate import METRICS, evaluate

    vec = spark.createDataFrame([(i, [float(i), float(i % 2)]) for i in range(8)], "entity long, features array<double>")
    labels = vec.selectExpr("entity", "cast(entity div 4 as int) as cluster")
    with pytest.raises(ValueError, match="insufficient clusters"):
        evaluate(vec, labels.selectExpr("entity", "0 as cluster"))
    row = evaluate(vec, labels).first().asDict()
    assert tuple(row) == METRICS and row["min_cluster_size"] == row["max_cluster_size"] == 4
    assert row["wcss"] is None and row["avg_inter_cluster_distance"] is None and row["avg_intra_cluster_distance"] > 0


def test_unknown_panel_id_is_named(spark, tmp_path):
    from pricelens.sources.panel_io import load_panel

    with pytest.raises(KeyError, match="unknown panel id"):
        load_panel(spark, str(tmp_path), "none")
