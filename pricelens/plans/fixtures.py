"""Inputs of the file queries: sheet trees and archives that Spark writes from
the driver tables into a fresh folder below the shared checkpoint directory, one
task a city.  Not part of the library's sources; the original never writes sheets."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SHEET_ITEM_COLUMN
from ..sources.sheets import file_system


def xlsx_bytes(rows: list[list[str]]) -> bytes:
    """Minimal one-sheet .xlsx with inline strings."""
    def col(i):
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    body = []
    for r, row in enumerate(rows, start=1):
        cells = "".join(
            f'<c r="{col(j)}{r}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for j, v in enumerate(row) if v is not None)
        body.append(f'<row r="{r}">{cells}</row>')
    sheet = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
             '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
             + "".join(body) + "</sheetData></worksheet>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def sheet_rows(pdf: pd.DataFrame, value_text: str = "cell") -> list[list[str]]:
    dates = sorted(pdf["Date"].unique())
    heads = [pd.Timestamp(d).strftime("%d/ %m/ %Y") for d in dates]
    rows = [["No", SHEET_ITEM_COLUMN, *heads]]
    for i, (item, g) in enumerate(sorted(pdf.groupby("Commodity"), key=lambda t: t[0]), start=1):
        m = dict(zip(g["Date"], g[value_text]))
        rows.append([str(i), item, *[m.get(d, "-") for d in dates]])
    return rows


def _put(path: str, data: bytes) -> None:
    system, p = file_system(path)
    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(p) as f:
        f.write(data)


def sheet_bytes(rows: list[list[str]], fmt: str) -> bytes:
    if fmt == "xlsx":
        return xlsx_bytes(rows)
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def write_sheets(cells: DataFrame, root: str, fmt: str = "xlsx") -> DataFrame:
    """One wide sheet per (Province, City, year) below ``root`` from long rows (Province,
    City, Commodity, Date, cell text): (path, rows) written."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sheet_rows(pdf)
        path = f"{root}/{pdf['Province'].iloc[0]}/{pdf['City'].iloc[0]}/{pd.Timestamp(pdf['Date'].iloc[0]).year}.{fmt}"
        _put(path, sheet_bytes(rows, fmt))
        return pd.DataFrame({"path": [path], "rows": [len(rows) - 1]})

    return cells.withColumn("_y", F.year("Date")).groupBy("Province", "City", "_y").applyInPandas(fn, "path string, rows long")


#: Fault planted in a city's sheets, by the remainder of its nation key; None: sound.
FAULTS = ("layout", "unreadable", "unparseable_dates", "no_date_columns", "no_numeric_data", "empty_item_column", None, None)


def _member(pdf: pd.DataFrame, fault: str | None) -> bytes:
    rows = sheet_rows(pdf)
    if fault == "unreadable":
        return b"no workbook"
    if fault == "unparseable_dates":
        rows[0] = [h.replace("/ ", "/") for h in rows[0]]
    elif fault == "no_date_columns":
        rows[0][2:] = [f"d{j}" for j in range(len(rows[0]) - 2)]
    elif fault == "no_numeric_data":
        rows[1:] = [[*r[:2], *["-" for _ in r[2:]]] for r in rows[1:]]
    elif fault == "empty_item_column":
        rows[1:] = [[r[0], "", *r[2:]] for r in rows[1:]]
    return xlsx_bytes(rows)


def write_zips(cells: DataFrame, root: str, wrapper: str = "data", fault: str | None = None) -> DataFrame:
    """One ZIP archive per city holding ``wrapper/PROVINCE/CITY/YYYY.xlsx`` members; ``fault``
    names a column of ``cells`` with the fault to plant."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        prov, city = pdf["Province"].iloc[0], pdf["City"].iloc[0]
        wrong = pdf[fault].iloc[0] if fault else None
        buf, n = io.BytesIO(), 0
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for year, g in pdf.groupby(pdf["Date"].dt.year):
                z.writestr(f"{wrapper}/{prov}/{city}/{year}.{'xls' if wrong == 'layout' else 'xlsx'}", _member(g, wrong))
                n += 1
        path = f"{root}/{prov}_{city}.zip"
        _put(path, buf.getvalue())
        return pd.DataFrame({"path": [path], "rows": [n]})

    return cells.groupBy("Province", "City").applyInPandas(fn, "path string, rows long")
