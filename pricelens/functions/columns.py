"""Scalar Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's configuration.
# Cell texts that mean "no value":
NULL_TOKENS = ["-", "", "nan", "NaN", "null", "NULL"]
# Commodities analysed by default (the item domain of the original panels):
DEFAULT_ITEMS = [
    "Beras",
    "Telur Ayam",
    "Daging Ayam",
    "Daging Sapi",
    "Bawang Merah",
    "Bawang Putih",
    "Cabai Merah",
    "Cabai Rawit",
    "Minyak Goreng",
    "Gula Pasir",
]
# Date header layout of the wide sheets, e.g. "01/ 02/ 2020" (day/ month/ year).
HEADER_DATE_FORMAT = "d/ M/ yyyy"
# Required long-panel columns and sheet columns.
PANEL_REQUIRED = ["City", "Commodity", "Date", "Price"]
SHEET_ITEM_COLUMN = "Komoditas (Rp)"
SHEET_DROP_COLUMNS = ["No"]
# Default analysis window (years, inclusive).
DEFAULT_YEAR_RANGE = (2020, 2024)
# ---------------------------------------------------------------------------

# A plain decimal or scientific number, or an infinity.  Anything else
# ("1.0f", "1d", "0x10", "12abc") is not a number even though Spark's cast
# would accept some of them.
_NUMERIC_RE = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c: str | Column, tokens: list[str] | None = None) -> Column:
    """Exact-match null indicators -> NULL (no trimming, like the original)."""
    c = _c(c)
    toks = NULL_TOKENS if tokens is None else tokens
    return F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: str | Column) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def parse_price(c: str | Column, commas: bool = True) -> Column:
    """Text price -> double: thousands commas removed (or, with ``commas=False``,
    not a number), surrounding blanks ignored; anything that is not a number
    (or NaN) becomes NULL."""
    s = _c(c).cast("string")
    s = F.trim(F.regexp_replace(s, ",", "") if commas else s)
    v = F.when(s.rlike(_NUMERIC_RE), s.try_cast("double"))
    return nan_to_null(v)


def parse_header_date(c: str | Column, fmt: str = HEADER_DATE_FORMAT) -> Column:
    """Sheet header text ('DD/ MM/ YYYY', runs of blanks allowed) -> timestamp;
    NULL when it does not parse."""
    s = F.regexp_replace(F.trim(_c(c)), r"\s+", " ")
    return F.try_to_timestamp(s, F.lit(fmt))


def period_label(ts: str | Column, freq: str) -> Column:
    """'all' -> 'all', 'Y' -> '2020', 'M' -> '2020-01'."""
    ts = _c(ts)
    if freq == "all":
        return F.lit("all")
    if freq == "Y":
        return F.date_format(ts, "yyyy")
    if freq == "M":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"unsupported frequency {freq!r}; use 'all', 'Y' or 'M'")


def elapsed_days(ts: str | Column, origin: str | Column) -> Column:
    """Whole 24-hour periods from ``origin`` to ``ts`` (floor), as a double."""
    micros = F.timestamp_diff("MICROSECOND", _c(origin), _c(ts))
    return F.floor(micros / F.lit(86_400_000_000)).cast("double")
