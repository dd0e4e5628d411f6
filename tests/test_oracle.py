"""Registered queries against their DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same
from tests.conftest import SF_SMALL

FAST = [
    "a1_feature_avg", "a2_feature_cv", "a3_feature_trend_ols", "a4_feature_trend_simple", "a5_feature_matrix_all",
    "a6_feature_matrix_monthly_long", "x1_scale_standard", "x2_scale_minmax", "x3_scale_robust", "a7_feature_report",
    "f1_filter_items", "f2_filter_panel", "f3_filter_date_range", "f4_drop_outliers_iqr", "f5_drop_outliers_zscore",
    "f6_drop_null_keys", "p3_null_tokens", "p4_parse_price", "p5_add_period", "w1_fill_gaps", "w1_fill_gaps_text",
    "w2_group_minmax", "z1_clean_panel", "a8_panel_summary", "a9_available_options", "a10_data_quality",
    "a10_completeness", "a15_data_checks_all", "a16_year_checks", "a11_cluster_sizes", "a12_cluster_members",
    "a13_cluster_geo_summary", "j1_attach_clusters", "j2_attach_coordinates", "j3_map_points", "j4_unknown_keys",
    "j5_dense_grid", "u1_consolidate", "u2_distinct_pairs", "o1_sort_desc", "o2_top_n", "j6_pairwise_sums",
    "e1_silhouette_samples", "e2_davies_bouldin", "e3_calinski_harabasz", "e4_size_balance", "e5_intra_distance",
    "e6_inter_distance", "e7_variance_split", "e10_adjusted_rand", "r1_monthly_trends", "r3_radar_profile",
    "r4_boxplot_stats", "r5_correlation_global", "r6_correlation_per_cluster", "r10_assignments",
    "c3_affinity_rbf_degrees", "c3_affinity_knn_graph", "c5_assign", "s1_scan_sheets", "s5_read_coordinates",
    "s6_panel_roundtrip", "d3_check_layout",
]


def test_every_query_registered_has_a_callable():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 90


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert_same(got, want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "City" in df.columns
