"""Composed pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import scale as sc
from ..session import checkpoint


def build_features(
    df: DataFrame,
    years: Sequence[int] | None = None,
    cities: Sequence[str] | None = None,
    items: Sequence[str] | None = None,
    features: Sequence[str] = ("avg",),
    freq: str = "all",
    min_points: int = 10,
    trend_method: str = "linear_regression",
    methods: Sequence[str] = ("robust",),
    use: str = "robust",
    report: bool = True,
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
    value: str = "Price",
):
    """Filter -> required columns -> feature matrix -> scale -> report.

    Returns (matrix wide, scaled wide, params, report|None)."""
    from ..operators.clean import filter_panel

    missing = [c for c in (entity, item, ts, value) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    d = filter_panel(df, years=years, cities=cities, items=items, entity=entity, item=item, ts=ts)
    long, names = fe.matrix_long(d, features, freq, min_points, trend_method, entity=entity, item=item, ts=ts, value=value)
    long = checkpoint(long)  # read by the parameters, both matrices and the report
    params = sc.fit_params(long, methods)
    scaled_long = sc.apply_params(long, params, use)
    wide = fe.to_wide(long, names, entity)
    scaled = fe.to_wide(scaled_long, names, entity)
    rep = fe.feature_report(long, entity=entity) if report else None
    return wide, scaled, params, rep


def clean_panel(
    df: DataFrame,
    items: Sequence[str] | None = None,
    outliers: str | None = None,
    threshold: float | None = None,
    keys: Sequence[str] = ("City", "Commodity"),
    order: Sequence[str] = ("Date",),
    item: str = "Commodity",
    value: str = "Price",
) -> DataFrame:
    """Null tokens -> gap fill (on the raw cells) -> price cast -> item
    filter -> optional outlier removal ('iqr' or 'zscore').

    The order matters and is kept: a cell that is not a listed token (for
    example a padded ' - ') is not filled and only turns NULL at the cast.
    ``keys`` bound the fill; pass ('Source_File', 'City', 'Commodity') to
    clean per input file like the original."""
    from ..operators import clean as cl

    d = cl.replace_null_tokens(df, [value])
    d = cl.fill_gaps(d, keys, order, value)
    d = cl.cast_price(d, value)
    d = cl.filter_items(d, items, item)
    if outliers == "iqr":
        d = cl.drop_outliers_iqr(d, 1.5 if threshold is None else threshold, item, value)
    elif outliers == "zscore":
        d = cl.drop_outliers_zscore(d, 3.0 if threshold is None else threshold, item, value)
    elif outliers is not None:
        raise ValueError("outliers must be None, 'iqr' or 'zscore'")
    return d


def analyze(df: DataFrame, algorithm: str = "kmeans", k: int = 3, features: Sequence[str] = ("avg",), freq: str = "all",
            min_points: int = 10, scaling: str = "robust", coords: DataFrame | None = None, entity: str = "City", **params):
    """Feature matrix -> scale -> matrix checks -> fit -> metrics ->
    report tables.  Returns (ClusterResult with ``entity`` labels, one-row
    metrics DataFrame with every metric, the whole report bundle of R12).
    Blocking check failures raise with every violation listed."""
    from ..operators import cluster as cl
    from ..operators import evaluate as ev
    from ..operators import report as rp
    from ..operators.summary import matrix_checks

    _, scaled, _, _ = build_features(df, features=features, freq=freq, min_points=min_points, methods=(scaling,), use=scaling,
                                     report=False, entity=entity)
    problems = matrix_checks(scaled, k=k, coords=coords, entity=entity).where(F.col("level") == "error").collect()
    if problems:
        raise ValueError("feature matrix rejected: " + "; ".join(f"{r['check']}: {r['detail']}" for r in problems))
    cols = [c for c in scaled.columns if c != entity]
    vec = scaled.select(F.col(entity).alias("entity"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("features"))
    res = cl.fit(vec, algorithm, k, **params)
    labels = res.labels.select(F.col("entity").alias(entity), F.col("cluster").alias("Cluster"))
    m = ev.evaluate(vec, res.labels, algorithm, res.centers)
    head = (F.lit(algorithm).alias("algorithm"), F.lit(k).alias("k"), F.lit(res.info["execution_time"]).alias("execution_time"))
    metrics = m.select(*head, "*")
    reports = rp.report(df, vec, labels, res.labels, coords, entity, names=cols)
    res.labels = labels
    return res, metrics, reports


def build_panel(spark, path: str, items: Sequence[str] | None = None, provinces: Sequence[str] | None = None,
                years: Sequence[int] | None = None, archives: bool = False, outliers: str | None = None,
                scanned: tuple[DataFrame, DataFrame] | None = None):
    """Discover -> scan -> melt -> clean per file -> one panel ->
    summary.  Returns (panel, catalog, failed files, summary row).  ``items``
    None keeps every item present; ``scanned`` are the cells and failed files
    of a scan already made."""
    from ..operators import clean as cl
    from ..operators.summary import panel_summary
    from ..sources import sheets as sh

    cells, failed = scanned or (sh.scan_zip if archives else sh.scan_sheets)(spark, path)
    catalog = sh.file_catalog(cells, provinces, years)
    if provinces or years:
        cells = cells.join(catalog.select("Source_File"), "Source_File", "left_semi")
    long = sh.cells_to_panel(cells)
    long = cl.replace_null_tokens(long)
    long = cl.fill_gaps(long, ("Source_File", "City", "Commodity"), ("Date",), "Price")
    long = cl.cast_price(long)
    if items is not None:
        long = cl.filter_items(long, items)
    if outliers == "iqr":
        long = cl.drop_outliers_iqr(long)
    elif outliers == "zscore":
        long = cl.drop_outliers_zscore(long)
    panel = long.select("Commodity", "City", "Province", "Source_File", "Date", "Price", "Year", "Month")
    return panel, catalog, failed, panel_summary(panel)


def validate_panel(spark, path: str, valid_cities=None, valid_items: Sequence[str] | None = None):
    """Z3: layout -> build -> structure, geography and item checks (all
    collected) -> metrics.  Returns (panel, violations, metrics)."""
    from ..functions.columns import DEFAULT_ITEMS
    from ..operators.joins import unknown_keys
    from ..operators.summary import data_checks
    from ..sources import sheets as sh

    found = sh.scan(spark, path, archives=True)  # read once
    layout = sh.check_layout(found.members, found.cells, found.failed, valid_cities)
    panel, _, _, metrics = build_panel(spark, path, items=None, scanned=(found.cells, found.failed))
    panel = checkpoint(panel)
    checks = data_checks(panel, first_only=False).select(F.col("step").cast("string").alias("subject"), "check", "detail")
    geo = (unknown_keys(panel, valid_cities, "City").select(F.col("City").alias("subject"), F.lit("unknown_city").alias("check"),
                                                            F.lit("not a supported city").alias("detail"))
           if valid_cities is not None else None)
    items = unknown_keys(panel, list(valid_items or DEFAULT_ITEMS), "Commodity").select(
        F.col("Commodity").alias("subject"), F.lit("unknown_commodity").alias("check"), F.lit("not a supported commodity").alias("detail"))
    v = layout.unionByName(checks).unionByName(items)
    if geo is not None:
        v = v.unionByName(geo)
    return panel, v, metrics
