"""Parsing, filtering, gap filling and outlier removal on the long panel
(P3-P5, F1-F6, W1, W2).

All operators are declarative DataFrame expressions so Catalyst pushes the
filters into the Parquet scan (year filters are written as date ranges for
that reason) and prunes unused columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DEFAULT_ITEMS, NULL_TOKENS, null_tokens, parse_price, period_label
from ..functions.quantiles import GRID, SKETCH, exact_quantiles, grid_ranks
from ..session import small_side


# ------------------------------------------------------------------ P3 - P5
def replace_null_tokens(df: DataFrame, cols: Sequence[str] = ("Price",), tokens: Sequence[str] | None = None) -> DataFrame:
    """Cells equal to a null indicator become NULL (exact match)."""
    toks = list(NULL_TOKENS if tokens is None else tokens)
    return df.withColumns({c: null_tokens(c, toks) for c in cols})


def cast_price(df: DataFrame, value: str = "Price") -> DataFrame:
    """Strip thousands commas, cast to double; other text -> NULL."""
    return df.withColumn(value, parse_price(value))


def add_period(df: DataFrame, freq: str, ts: str = "Date", name: str = "Period") -> DataFrame:
    """P5: period label 'all', 'YYYY' or 'YYYY-MM'."""
    return df.withColumn(name, period_label(ts, freq))


def add_year_month(df: DataFrame, ts: str = "Date") -> DataFrame:
    """Year (string, never '2020.0') and Month (int) columns of the long panel."""
    return df.withColumn("Year", F.date_format(ts, "yyyy")).withColumn("Month", F.month(ts))


# ------------------------------------------------------------------ F1 - F6
def _year_ranges(years: Sequence[int], ts: str) -> Column:
    """OR of half-open date ranges over runs of consecutive years, so the
    predicate is a plain range comparison that Parquet can push down."""
    ys = sorted({int(y) for y in years})
    runs, start, prev = [], ys[0], ys[0]
    for y in ys[1:]:
        if y != prev + 1:
            runs.append((start, prev))
            start = y
        prev = y
    runs.append((start, prev))
    cond = None
    for a, b in runs:
        c = (F.col(ts) >= F.lit(f"{a}-01-01").cast("timestamp_ntz")) & (F.col(ts) < F.lit(f"{b + 1}-01-01").cast("timestamp_ntz"))
        cond = c if cond is None else (cond | c)
    return cond


def filter_items(df: DataFrame, items: Sequence[str] | None = None, item: str = "Commodity") -> DataFrame:
    """keep the configured items (default: the original ten commodities)."""
    items = list(DEFAULT_ITEMS if items is None else items)
    return df.where(F.col(item).isin(items))


def filter_panel(
    df: DataFrame,
    years: Sequence[int] | None = None,
    cities: Sequence[str] | None = None,
    items: Sequence[str] | None = None,
    entity: str = "City",
    item: str = "Commodity",
    ts: str = "Date",
) -> DataFrame:
    """optional year / city / item selection; empty or None = no filter."""
    if years:
        df = df.where(_year_ranges(years, ts))
    if cities:
        df = df.where(F.col(entity).isin(list(cities)))
    if items:
        df = df.where(F.col(item).isin(list(items)))
    return df


def filter_date_range(df: DataFrame, start_year: int = 2020, end_year: int = 2024, ts: str = "Date") -> DataFrame:
    """drop NULL dates and keep [start-01-01 00:00, end-12-31 00:00]
    (later times on 31 December fall outside, as in the original)."""
    lo = F.lit(f"{start_year}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{end_year}-12-31 00:00:00").cast("timestamp_ntz")
    return df.where(F.col(ts).isNotNull() & (F.col(ts) >= lo) & (F.col(ts) <= hi))


def drop_outliers_iqr(df: DataFrame, threshold: float = 1.5, item: str = "Commodity", value: str = "Price") -> DataFrame:
    """per item drop prices outside [Q1 - t*IQR, Q3 + t*IQR]; NULL prices
    are kept.  Quartiles are exact (see ``exact_quantiles``); the per-item
    bounds table has one row per item and is joined back."""
    q = exact_quantiles(df, [item], value, [0.25, 0.75], names=["_q1", "_q3"])
    b = q.select(
        item,
        (F.col("_q1") - threshold * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
        (F.col("_q3") + threshold * (F.col("_q3") - F.col("_q1"))).alias("_hi"),
    )
    v = F.col(value)
    keep = v.isNull() | F.col("_lo").isNull() | ((v >= F.col("_lo")) & (v <= F.col("_hi")))
    return df.join(small_side(b), item, "left").where(keep).drop("_lo", "_hi")


def drop_outliers_zscore(df: DataFrame, threshold: float = 3.0, item: str = "Commodity", value: str = "Price") -> DataFrame:
    """per item drop rows with |(p - mean) / sample std| > t; NULL prices
    and zero / undefined std are kept."""
    s = df.groupBy(item).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    z = F.abs(F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")))
    return df.join(small_side(s), item, "left").where(z.isNull() | (z <= threshold)).drop("_mu", "_sd")


def drop_null_keys(df: DataFrame, cols: Sequence[str] = ("Date", "Price", "Cluster")) -> DataFrame:
    """drop rows with NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


# ------------------------------------------------------------------ W1, W2
def _on_null_safe(keys: Sequence[str], prefix: str) -> Column:
    """Join condition in which a null key equals a null key of the other, prefixed side."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def _order_number(df: DataFrame, col: str) -> Column | None:
    """A double that never decreases along the order of ``col``, None for types without one."""
    kind, c = df.schema[col].dataType.typeName(), F.col(col)
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return c.cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind in ("string", "binary"):  # the first six bytes
        head = F.hex(F.substring(c.cast("binary"), 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    return None


#: Rows of a group beyond which it is cut into several ranges of its order.
CHUNK_ROWS = 1_000_000


def fill_chunks(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Groups with more than ``chunk_rows`` rows and the cuts of their order
    (at most 1023, from a quantile sketch): (keys prefixed ``_h_``, _cuts).  At most rows / chunk_rows groups."""
    number = _order_number(df, order)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(number).alias("_m"), F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("_sk"))
    g = g.where((F.col("_n") > chunk_rows) & (F.col("_m") > 0))
    grid = F.kll_sketch_get_quantile_double("_sk", grid_ranks())
    parts = F.least(F.ceil(F.col("_n") / chunk_rows), F.lit(GRID)).cast("int")
    at = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.element_at("_grid", F.greatest(F.floor(j * GRID / parts), F.lit(1)).cast("int")))
    cuts = F.array_sort(F.array_distinct(at))
    return g.withColumn("_grid", grid).select(*[F.col(k).alias(f"_h_{k}") for k in keys], cuts.alias("_cuts"))


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str] = ("City", "Commodity"),
    order: Sequence[str] = ("Date",),
    value: str = "Price",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Within each group ordered by ``order``: forward fill, then fill the
    leading gap with the group's first value.  A group that has no value at
    all stays NULL (fills never cross groups).

    A parallel prefix scan: a group of more than ``chunk_rows`` rows is cut into
    ranges of its first order column (any type that has an order-preserving
    number; the cuts come from a quantile sketch, rows with equal values stay
    together), each range is filled by itself, and the value carried into it
    is the last value of the ranges before, from a table with one row a range.
    Rows are shuffled once, by group and range.  The tables of cuts and carries have rows
    for large groups only."""
    keys, order = list(keys), list(order)
    v, number = F.col(value), _order_number(df, order[0])
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hot = small_side(fill_chunks(df, keys, order[0], chunk_rows)) if number is not None else None
    d = df.withColumn("_ck", F.lit(0))
    if hot is not None:
        range_of = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= number))).otherwise(0)
        d = df.join(hot, _on_null_safe(keys, "_h_"), "left").withColumn("_ck", range_of)
        okey = F.when(v.isNotNull(), F.struct(*order))  # NULL ordering = row ignored by min_by/max_by
        ranges = d.where(F.col("_cuts").isNotNull()).groupBy(*keys, "_ck").agg(F.max_by(v, okey).alias("_last"), F.min_by(v, okey).alias("_head"))
        wc = Window.partitionBy(*keys).orderBy("_ck")  # at most 1024 ranges a group
        carry = ranges.select(
            *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_ck").alias("_r__ck"),
            F.last("_last", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
            F.first("_head", ignorenulls=True).over(whole(wc)).alias("_first"),
        )
        carry = small_side(carry)
        # a range's carry reaches its rows before the shuffle
        d = d.join(carry, _on_null_safe([*keys, "_ck"], "_r_"), "left").drop("_cuts", *[f"_h_{k}" for k in keys], *[f"_r_{k}" for k in keys], "_r__ck")
    else:
        d = d.withColumns({"_carry": F.lit(None).cast(df.schema[value].dataType), "_first": F.lit(None).cast(df.schema[value].dataType)})
    w = Window.partitionBy(*keys, "_ck").orderBy(*order)
    d = d.withColumns({"_ff": F.last(v, ignorenulls=True).over(ahead(w)), "_own": F.first(v, ignorenulls=True).over(whole(w))})
    # in a group that was cut, "_first" is there whenever "_own" is
    return d.withColumn(value, F.coalesce("_ff", "_carry", "_first", "_own")).drop("_ff", "_own", "_carry", "_first", "_ck").select(*df.columns)


def group_minmax(df: DataFrame, key: str = "Commodity", value: str = "value", prefix: str = "group_") -> DataFrame:
    """Min and max of ``value`` over the rows sharing ``key``, as two new
    columns (aggregate + join rather than an unbounded window, so a hot key
    is combined map-side)."""
    s = df.groupBy(key).agg(F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"))
    return df.join(small_side(s), key, "left")
