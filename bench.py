"""Benchmark of the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is fully materialised with the ``noop`` sink (all rows computed,
nothing collected)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pricelens.session import local_session  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="pricelens-bench")
    from pricelens.operators import clean as cl
    from pricelens.operators import cluster as clu
    from pricelens.operators import evaluate as ev
    from pricelens.operators import features as fe
    from pricelens.operators import report as rp
    from pricelens.plans.pipelines import build_features, clean_panel
    from pricelens.sources import tables as tb

    def q_features_all():
        _, scaled, _, _ = build_features(tb.panel_p(spark, sf_dir), features=("avg", "cv", "trend"), report=False)
        run(scaled)

    def q_features_monthly():
        run(fe.feature_matrix(cl.filter_panel(tb.panel_p(spark, sf_dir)), ("avg",), freq="M"))

    def q_fill_outliers():
        run(clean_panel(tb.panel_v_text(spark, sf_dir), items=["click", "view", "purchase", "signup"],
                        order=["Date", "event_id"], outliers="iqr"))

    def q_boxplot():
        stats, outl = rp.boxplot_stats(tb.panel_p(spark, sf_dir), tb.labels_p(spark, sf_dir))
        run(stats)
        run(outl)

    def q_correlation():
        e = tb.table(spark, sf_dir, "events")
        d = e.select(F.col("user_id").cast("string").alias("City"), F.col("event_type").alias("Commodity"),
                     F.date_trunc("day", "ts").alias("Date"), F.col("value").alias("Price"))
        run(rp.correlation(d))

    def q_silhouette():
        run(ev.silhouette_samples(tb.matrix_m(spark, sf_dir), tb.labels_m(spark, sf_dir)))

    def q_kmeans():
        res = clu.kmeans(tb.matrix_m(spark, sf_dir), 10, n_init=10, seed=42)
        run(res.labels)

    plan = [
        ("feature_matrix_all", q_features_all),
        ("feature_matrix_monthly", q_features_monthly),
        ("gap_fill_outliers", q_fill_outliers),
        ("boxplot_stats", q_boxplot),
        ("correlation_global", q_correlation),
        ("silhouette_exact", q_silhouette),
        ("kmeans_10x_k10", q_kmeans),
    ]
    # warm-up: JVM, Python workers and the parquet footers (not timed)
    run(tb.panel_p(spark, sf_dir).limit(10))
    times = {}
    for name, fn in plan:
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
