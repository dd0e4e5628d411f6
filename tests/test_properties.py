"""Properties of the iterative / library-style operators and the quirk
decisions (see the survey's quirk table)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.quantiles import exact_quantiles
from pricelens.functions.stats import betainc, pearson_p
from pricelens.operators import clean as cl
from pricelens.operators import cluster as clu
from pricelens.operators import evaluate as ev
from pricelens.operators import features as fe
from pricelens.operators import report as rp
from pricelens.operators import scale as sc
from pricelens.operators import spectral as sp
from pricelens.sources import tables as tb
from tests.conftest import SF_SMALL


def blobs(spark, n=60, k=3, d=4, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 10, (k, d))
    rows = [(int(i), [float(x) for x in centers[i % k] + rng.normal(0, 0.5, d)]) for i in range(n)]
    return spark.createDataFrame(rows, "entity long, features array<double>"), np.array([i % k for i in range(n)])


@pytest.mark.parametrize("sketch, margin", [(4096, None), (8, None), (8, 0.0)])
def test_exact_quantiles_whatever_the_sketch(spark, sketch, margin):
    """Also with brackets that miss their ranks: those groups are taken again."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 6000), "v": np.round(rng.lognormal(2, 1, 6000), 2)})
    pdf.loc[pdf.k == 1, "v"] = 4.0  # a constant group
    pdf.loc[pdf.k == 2, "v"] **= 40  # a wide range
    pdf = pd.concat([pdf, pd.DataFrame({"k": [7, 8, 8], "v": [3.5, 1.0, 2.0]})])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, sketch=sketch, margin=margin).toPandas().sort_values("k").to_numpy()
    assert np.allclose(got[:, 1:], pdf.groupby("k").v.quantile(probs).unstack().to_numpy())


def test_exact_quantiles_of_null_keys_and_no_values(spark):
    rows = [(None, "x", 1.0), (None, "x", 3.0), ("a", None, None), ("a", "y", float("nan")), ("b", "y", 2.0), ("b", "y", None)]
    df = spark.createDataFrame(rows, "k string, j string, v double")
    got = {(r["k"], r["j"]): r["q50"] for r in exact_quantiles(df, ["k", "j"], "v", [0.5]).collect()}
    assert got == {(None, "x"): 2.0, ("b", "y"): 2.0}
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).collect()[0]["q50"] is None


def test_kmeans_properties(spark):
    vec, truth = blobs(spark)
    res = clu.kmeans(vec, 3, n_init=3, seed=1)
    lab = res.labels.toPandas().sort_values("entity")
    # separated blobs are recovered exactly (up to label names)
    ari = ev.adjusted_rand(res.labels, spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "entity long, cluster int"))
    assert abs(ari.first()["ari"] - 1.0) < 1e-9
    # each row is assigned to its nearest center
    C = np.array([r["center"] for r in res.centers.orderBy("cluster").collect()])
    X = np.vstack(vec.orderBy("entity").toPandas()["features"].map(np.asarray))
    assert (((X[:, None, :] - C[None]) ** 2).sum(2).argmin(1) == lab["cluster"].to_numpy()).all()
    # WCSS + BCSS = TSS at convergence
    v = ev.variance_split(vec, res.labels).first()
    assert math.isclose(v["wcss"] + v["bcss"], v["tss"], rel_tol=1e-9)
    assert math.isclose(v["wcss"], res.info["inertia"], rel_tol=1e-6)


def test_fcm_memberships(spark):
    vec, _ = blobs(spark, n=45)
    res = clu.fcm(vec, 3, seed=3)
    u = res.memberships.groupBy("entity").agg(F.sum("u").alias("s")).toPandas()
    assert np.allclose(u["s"], 1.0)
    assert 1 / 3 - 1e-9 <= res.info["fpc"] <= 1 + 1e-9


def test_spectral_separates_blobs(spark):
    vec, truth = blobs(spark, n=36, d=3)
    res = sp.spectral(vec, 3, affinity="rbf", gamma=0.1, n_init=3, block_rows=16, max_iter=15)
    t = spark.createDataFrame([(i, int(x)) for i, x in enumerate(truth)], "entity long, cluster int")
    assert ev.adjusted_rand(res.labels, t).first()["ari"] > 0.99


def test_silhouette_bounds_and_singletons(spark):
    vec, truth = blobs(spark, n=30)
    lab = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)] + [(100, 9)], "entity long, cluster int")
    v2 = vec.unionByName(spark.createDataFrame([(100, [50.0, 50.0, 50.0, 50.0])], "entity long, features array<double>"))
    s = ev.silhouette_samples(v2, lab, block_rows=7).toPandas()
    assert ((s.silhouette >= -1) & (s.silhouette <= 1)).all()
    assert s.loc[s.entity == 100, "silhouette"].iloc[0] == 0.0


def test_adjusted_rand_identity(spark):
    lb = tb.labels_m(spark, SF_SMALL)
    assert abs(ev.adjusted_rand(lb, lb).first()["ari"] - 1.0) < 1e-12


def test_pca_scores_uncorrelated_and_ordered(spark):
    pts, load, var = rp.project_2d(tb.matrix_m(spark, SF_SMALL))
    p = pts.toPandas()
    assert abs(np.corrcoef(p.pc1, p.pc2)[0, 1]) < 1e-6
    v = var.toPandas().set_index("component")["explained_variance"]
    assert v["pc1"] >= v["pc2"]
    L = load.toPandas()
    for c in ("pc1", "pc2"):
        assert L[c].iloc[L[c].abs().argmax()] > 0


def test_fill_never_changes_values_and_stays_in_group(spark):
    rows = [("a", "x", 1, None), ("a", "x", 2, 5.0), ("a", "x", 3, None), ("b", "x", 1, None), ("b", "x", 2, None),
            ("c", "x", 1, 7.0), ("c", "x", 2, None)]
    df = spark.createDataFrame(rows, "City string, Commodity string, d int, Price double").withColumn(
        "Date", F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.col("d"), F.lit(0), F.lit(0), F.lit(0)))
    out = {(r.City, r.d): r.Price for r in cl.fill_gaps(df).collect()}
    assert out[("a", 1)] == 5.0 and out[("a", 2)] == 5.0 and out[("a", 3)] == 5.0
    assert out[("b", 1)] is None and out[("b", 2)] is None  # all-null group stays null (no leak)
    assert out[("c", 2)] == 7.0


def test_scalers(spark):
    fx = spark.createDataFrame([(str(i), "f", float(v)) for i, v in enumerate([1, 2, 4, 9])] + [("9", "g", 3.0), ("8", "g", 3.0)],
                               "City string, feature string, value double")
    r, params = sc.scale(fx, "robust")
    p = params.toPandas().set_index("feature")
    assert p.loc["f", "center"] == 3.0 and p.loc["f", "scale"] == 3.5  # exact quartiles, not Spark ML's
    assert p.loc["g", "scale"] == 1.0  # zero IQR -> 1
    m, _ = sc.scale(fx, "minmax")
    vals = m.where("feature = 'f'").toPandas().value
    assert vals.min() == 0.0 and vals.max() == 1.0
    s, _ = sc.scale(fx, "standard")
    assert abs(s.where("feature = 'f'").toPandas().value.mean()) < 1e-12


def test_trend_edge_cases(spark):
    rows = [("c", "i", 1, 10.0), ("c", "i", 1, 12.0), ("c", "i", 1, 11.0), ("d", "i", 1, 1.0), ("d", "i", 2, 2.0)]
    df = spark.createDataFrame(rows, "City string, Commodity string, d int, Price double").withColumn(
        "Date", F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.col("d"), F.lit(0), F.lit(0), F.lit(0)))
    t = fe.feature_values(df, ("trend",), min_points=1).toPandas().set_index("City")["trend"]
    assert t["c"] == 0.0  # all days equal -> 0.0 like least squares
    assert pd.isna(t["d"])  # fewer than 3 points


def test_pvalues_known():
    # t-distribution identities: I_x(a, b) symmetric; r=0.5, n=10 -> p ~ 0.1411
    assert abs(betainc(2.0, 3.0, 0.4) + betainc(3.0, 2.0, 0.6) - 1.0) < 1e-12
    assert abs(pearson_p(0.5, 10) - 0.14111) < 1e-4
    assert pearson_p(0.9, 2) is None and pearson_p(1.0, 5) == 0.0


def test_merged_features_are_those_of_the_rows(spark):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({"City": rng.choice(["a", "b", None], n), "Commodity": "x", "h": rng.integers(0, 400, n),
                        "Price": np.where(rng.random(n) < 0.2, np.nan, 1e6 + rng.normal(0, 1, n))})
    pdf["Date"] = pd.Timestamp("2020-01-01 07:00") + pd.to_timedelta(pdf.h * 5, unit="h")
    df = spark.createDataFrame(pdf).withColumn("Price", F.nanvl("Price", F.lit(None)))
    got = fe.feature_values(df, ("avg", "cv", "trend"), min_points=1).toPandas()
    got["City"] = got["City"].where(got["City"].notna(), None)
    for city, g in pdf.assign(City=pdf.City.fillna("")).groupby("City"):
        g = g.dropna(subset=["Price"])
        days = ((g.Date - g.Date.min()) // pd.Timedelta(days=1)).to_numpy(float)
        row = got[got.City.isna()] if city == "" else got[got.City == city]
        assert np.allclose(row[["avg", "cv", "trend"]].to_numpy(float)[0], [g.Price.mean(), g.Price.std() / g.Price.mean(), np.polyfit(days, g.Price - 1e6, 1)[0]], rtol=1e-5)


def test_trend_reads_the_panel_once(spark):
    plan = fe.feature_values(tb.panel_v(spark, SF_SMALL), ("trend",))._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower() and "event" not in plan  # only the states are left to read


def test_matrix_with_ten_thousand_columns_keeps_its_plan(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("City"), F.concat(F.lit("i"), (F.col("id") % 5000).cast("string")).alias("Commodity"),
                                    F.lit("2020-01-01").cast("timestamp_ntz").alias("Date"), F.col("id").cast("double").alias("Price"))
    v = fe.matrix_vector(df, ("avg", "cv"), min_points=1)
    assert len(v._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    rows = v.collect()
    assert len(rows) == 3 and all(len(r["features"]) == len(r["names"]) == 10_000 for r in rows)
    assert rows[0]["names"][:2] == ["i0_avg", "i0_cv"]


def _plain_knn(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, 0.0)
    edges = {}
    for a, row in enumerate(d):
        for b in np.lexsort((np.arange(len(x)), np.round(row, 9)))[:k]:
            edges[a, b] = edges.get((a, b), 0) + 0.5
            edges[b, a] = edges.get((b, a), 0) + 0.5
    return edges


@pytest.mark.parametrize("pivots, block_rows", [(1, 64), (12, None), (12, 16), (40, 10)])
def test_knn_graph_is_that_of_all_pairs(spark, pivots, block_rows):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 5)) * 0.2 + 6 * rng.normal(size=5) for _ in range(3)] + [rng.normal(size=(40, 5)) * 8])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, features array<double>").repartition(4)
    got = {(r["a"], r["b"]): r["w"] for r in sp.knn_graph(df, 7, block_rows=block_rows, pivots=pivots).collect()}
    assert got == _plain_knn(x, 7)


def test_knn_index_rules_out_most_tiles_of_clustered_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 8)) * 0.1 + 9 * rng.normal(size=8) for _ in range(10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, features array<double>")
    rows, pairs = sp.knn_tiles(df, 10, pivots=10)
    assert rows.count() == 600 and pairs.count() < 0.5 * 10 * 10


def test_tiles_of_one_cluster_only(spark):
    df = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(90)], "entity long, cluster int, features array<double>")
    from pricelens.operators import pairwise as pw

    blocks = pw.packed_blocks(df.withColumn("_nb", F.lit(4)), "_nb", "entity", "cluster")
    placed = pw.tiles(blocks).select("g", F.explode("rows.cluster").alias("c")).where("g <> c")
    assert placed.count() == 0 and blocks.count() == 12
    x = np.arange(0, 90.0, 3)
    want = np.abs(x[:, None] - x[None])[np.triu_indices(30, 1)]
    for kw in ({"block_rows": 7}, {}):
        assert all(abs(r["dsum"] - want.sum()) < 1e-6 and r["cnt"] == len(want) for r in pw.intra_pair_sums(df, **kw).collect())


def test_bucketed_panel_needs_no_exchange(spark, tmp_path):
    names = tb.write_bucketed_panel(spark, SF_SMALL, str(tmp_path), buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = tb.panel_p_bucketed(spark, *names)
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        key = ["Province", "City", "Commodity", "Date", "Price"]
        want = tb.panel_p(spark, SF_SMALL).select(key)
        assert p.exceptAll(want).count() == 0 and want.exceptAll(p).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_parse_quirks(spark):
    from pricelens.functions.columns import parse_header_date, parse_price

    nums = ["1,000", " 7 ", "1e3", "1.0f", "1d", "inf", "nan", "0x10", "-", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in nums], "s string").select(parse_price("s")).collect()]
    assert got[:3] == [1000.0, 7.0, 1000.0]
    assert got[3] is None and got[4] is None and got[6] is None and got[7] is None
    assert got[5] == float("inf")
    heads = ["01/ 01/ 2020", "1/ 1/ 2020", "01/  02/ 2020", "01/01/2020", "31/ 02/ 2020", "Total"]
    d = [r[0] for r in spark.createDataFrame([(x,) for x in heads], "s string").select(parse_header_date("s")).collect()]
    assert d[0] is not None and d[1] == d[0] and d[2] is not None
    assert d[3] is None and d[4] is None and d[5] is None


def test_sheet_scan_isolates_bad_files(spark, tmp_path):
    from pricelens.sources import sheets as sh
    from pricelens.plans.fixtures import xlsx_bytes

    good = tmp_path / "P1" / "C1"
    good.mkdir(parents=True)
    (good / "2020.xlsx").write_bytes(xlsx_bytes([["No", "Komoditas (Rp)", "01/ 01/ 2020", "02/ 01/ 2020"],
                                                 ["1", "Beras", "12,500", "-"]]))
    (good / "2021.xlsx").write_bytes(b"not a zip")
    cells, failed = sh.scan_sheets(spark, str(tmp_path))
    c = cells.toPandas()
    assert set(c.header) == {"01/ 01/ 2020", "02/ 01/ 2020"} and (c.City == "C1").all() and (c.Province == "P1").all()
    assert failed.count() == 1


def _workbook(sheets, order):
    """Workbook with sheets by file number, listed in ``order``."""
    import io
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, data in sheets.items():
            z.writestr(f"xl/worksheets/sheet{n}.xml", data)
        if order:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{n}" sheetId="{n}" r:id="rId{n}"/>' for n in order) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
                f'<Relationship Id="rId{n}" Target="{"/xl/" if n == 2 else ""}worksheets/sheet{n}.xml"/>' for n in order) + "</Relationships>")
    return buf.getvalue()


def test_first_sheet_is_that_of_the_workbook():
    import io
    import zipfile

    from pricelens.plans.fixtures import xlsx_bytes
    from pricelens.sources import sheets as sh

    def sheet(text):
        return zipfile.ZipFile(io.BytesIO(xlsx_bytes([[text]]))).read("xl/worksheets/sheet1.xml")

    sheets = {n: sheet(f"sheet {n}") for n in (2, 3, 10)}
    for order, first in (([3, 2], 3), ([2, 3], 2), ([10, 2], 10), ([], 2)):
        assert list(sh.xlsx_rows(io.BytesIO(_workbook(sheets, order)))) == [[f"sheet {first}"]]


def test_archives_are_read_by_member(spark, tmp_path):
    import zipfile

    from pricelens.plans.fixtures import xlsx_bytes
    from pricelens.sources import sheets as sh

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for y in range(2000, 2012):
            z.writestr(f"data/P/C/{y}.xlsx", xlsx_bytes([["No", "Komoditas (Rp)", f"01/ 01/ {y}"], ["1", "Beras", str(y)]]))
        z.writestr("data/P/C/~$2000.xlsx", b"lock")
    (tmp_path / "b.zip").write_bytes(b"broken")
    found = sh.scan(spark, f"file://{tmp_path}", archives=True, partition_bytes=1)
    assert len(sh.SheetReader({"path": str(tmp_path), "archives": "true", "partitionBytes": "1"}).partitions()) == 14
    assert sorted(int(r["cell"]) for r in found.cells.collect()) == list(range(2000, 2012))
    assert [r["archive"].endswith("b.zip") for r in found.failed.collect()] == [True] and found.members.count() == 13
    big = sh.SheetReader({"path": str(tmp_path), "archives": "true"}).partitions()
    assert len(big) == 1 and len(big[0].members) == 14


def test_results_do_not_depend_on_shuffle_partitions(spark):
    from pricelens.plans import registry

    registry.load_all()
    q = registry.QUERIES["a5_feature_matrix_all"]
    a = q(spark, SF_SMALL).toPandas().sort_values("City").reset_index(drop=True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = q(spark, SF_SMALL).toPandas().sort_values("City").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("kernel", ["rbf", "cosine"])
def test_affinity_degree_positive(spark, kernel):
    vec, _ = blobs(spark, n=20)
    d = sp.affinity_degrees(vec, kernel, gamma=0.01, block_rows=6).toPandas()
    assert len(d) == 20


def test_global_quantile_matches_numpy(spark):
    v = np.round(np.random.default_rng(11).normal(100, 15, 5000), 3)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = exact_quantiles(df, [], "v", [0.1, 0.5, 0.9], sketch=64).first()
    assert np.allclose(list(got), np.quantile(v, [0.1, 0.5, 0.9]))


def _plain_fill(df, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.coalesce(F.last("Price", True).over(ahead), F.first("Price", True).over(whole))
    return {r["n"]: r["v"] for r in df.select("n", v.alias("v")).collect()}


@pytest.mark.parametrize("kind", ["int", "string", "double", "date", "timestamp", "decimal(20,2)", "boolean"])
def test_fill_of_a_long_group_is_that_of_one_window(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(700):
        city = ["hot", "hot", "hot", "cold", None][n % 5]
        at = None if n % 97 == 0 else int(rng.integers(0, 60))  # ties and nulls, broken by n
        rows.append((city, "x", at, n, float(n) if rng.random() < 0.15 and (at or 0) > 3 else None))
    df = spark.createDataFrame(rows, "City string, Commodity string, at int, n int, Price double").repartition(5)
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("at"))
    key = {"int": F.col("at"), "string": F.concat(F.lit("é"), F.lpad(F.col("at").cast("string"), 3, "0")), "double": F.when(F.col("at") == 50, F.lit(float("nan"))).otherwise(F.col("at") / 7),
           "date": day, "timestamp": day.cast("timestamp"), "decimal(20,2)": F.col("at").cast("decimal(20,2)"), "boolean": F.col("at") > 30}[kind]
    df = df.withColumn("k", key)
    got = {r["n"]: r["Price"] for r in cl.fill_gaps(df, order=["k", "n"], chunk_rows=40).collect()}
    assert got == _plain_fill(df, ["City", "Commodity"], ["k", "n"])


def test_fill_splits_a_hot_group_with_integer_order(spark):
    df = spark.range(4000).select(F.lit("a").alias("City"), F.lit("x").alias("Commodity"), F.col("id").alias("n"), F.when(F.col("id") % 900 == 5, F.col("id").cast("double")).alias("Price"))
    cuts = cl.fill_chunks(df, ["City", "Commodity"], "n", chunk_rows=500).collect()
    assert len(cuts) == 1 and 6 <= len(cuts[0]["_cuts"]) <= 8
    assert {r["n"]: r["Price"] for r in cl.fill_gaps(df, order=["n"], chunk_rows=500).collect()} == _plain_fill(df, ["City", "Commodity"], ["n"])
