"""Wide price sheets: scanning trees and ZIP archives of ``[ROOT/]PROVINCE/
CITY/YYYY.xlsx`` (or ``.csv``) into one long table (S1, S2, D1-D3, P1, P2).

The scan is a Spark data source, ``spark.read.format("price_sheets")``.  Its
partitions are sheets and archive members: file names and the directories at
the end of the archives are listed first (no content is read), then each task
opens its members by itself, so one archive is read by as many tasks as it has
members.  Small members share a task up to ``partitionBytes``.  Rows are
streamed out of ``.xlsx`` (zip + XML, standard library; the first sheet in
workbook order) and ``.csv`` as Arrow batches, in long form: one row per (file,
sheet row, column) cell, province and city taken from the path.  Files are
opened through Arrow's file systems, so the folder may be any that all
executors reach.  A file that cannot be decoded becomes an error row instead of
failing the job.  Every later step (date parsing, cleaning, catalog, checks) is a
DataFrame plan over the one scan.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import SHEET_DROP_COLUMNS, SHEET_ITEM_COLUMN, parse_header_date
from ..session import checkpoint

CELLS_SCHEMA = (
    "Source_File string, archive string, Province string, City string, file_size long, sheet_row int, "
    "Commodity string, header string, cell string, error string"
)
BATCH_CELLS = 16_384
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# header text of a date column: DD/ MM/ YYYY with optional blanks (layout rule)
HEADER_RE = r"^\d{1,2}/\s*\d{1,2}/\s*\d{4}$"
LAYOUT_RE = r"^([^/]+/)?[^/]+/[^/]+/[^/]+\.xlsx$"


# ------------------------------------------------------------------ decoding
def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    """Member name of the first worksheet in workbook order (by number where a workbook has no list)."""
    names = set(z.namelist())
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    if not sheets:
        raise ValueError("workbook has no worksheet")
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            name = target.get(sheet.get(_REL)) or ""
            name = name.lstrip("/") if name.startswith("/") else posixpath.normpath(posixpath.join("xl", name))
            if name in names:
                return name
    return min(sheets, key=lambda n: (int((re.findall(r"\d+", n) or ["0"])[-1]), n))


def xlsx_rows(file) -> Iterator[list[str | None]]:
    """Rows of cell texts of the first worksheet, streamed (the shared strings are held)."""
    with zipfile.ZipFile(file) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, si in ET.iterparse(f):
                    if si.tag == f"{_NS}si":
                        shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
                        si.clear()
        with z.open(_first_sheet(z)) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: dict[int, str | None] = {}
                for n, c in enumerate(row.findall(f"{_NS}c")):
                    kind, v = c.get("t"), c.find(f"{_NS}v")
                    if kind == "s" and v is not None:
                        val = shared[int(v.text)]
                    elif kind == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(f"{_NS}t"))
                    else:
                        val = v.text if v is not None else None
                    cells[_col_index(c.get("r")) if c.get("r") else n] = val
                yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]
                row.clear()


def csv_rows(file) -> Iterator[list[str | None]]:
    yield from csv.reader(io.TextIOWrapper(file, encoding="utf-8-sig", newline=""))


# ------------------------------------------------------------------ data source
@dataclass
class Member:
    """One sheet: its path or archive member, the path below the root, its size."""

    source: str
    archive: str | None
    rel: str
    size: int
    error: str | None = None


class SheetPartition(InputPartition):
    def __init__(self, members: list[Member]):
        self.members = members


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _strip_root(names: Sequence[str]) -> str:
    """Common wrapper directory of archive members, if there is exactly one."""
    tops = {n.split("/")[0] for n in names if "/" in n}
    if len(tops) == 1:
        top = next(iter(tops))
        if any(n.startswith(top + "/") and n.count("/") >= 3 for n in names):
            return top + "/"
    return ""


def _hidden(name: str) -> bool:
    return posixpath.basename(name).startswith((".", "~$")) or "__MACOSX" in name


def list_members(path: str, extensions: Sequence[str], archives: bool) -> Iterator[Member]:
    """Sheets below ``path``, or the members of the archives below it (their directories only)."""
    system, root = file_system(path)
    root = root.rstrip("/")
    for info in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        low = info.path.lower()
        if info.type != pafs.FileType.File or _hidden(info.path):
            continue
        if not archives:
            if low.endswith(tuple(f".{e}" for e in extensions)):
                yield Member(info.path, None, info.path[len(root) + 1 :], info.size)
        elif low.endswith(".zip"):
            try:
                with system.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                    inside = [i for i in z.infolist() if not i.is_dir()]
            except Exception as e:  # one bad archive must not fail the run
                yield Member(info.path, info.path, "", info.size, f"{type(e).__name__}: {e}")
                continue
            pre = _strip_root([i.filename for i in inside])
            for i in inside:
                yield Member(i.filename, info.path, i.filename.removeprefix(pre), i.file_size)


class SheetReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.archives = options.get("archives", "false") == "true"
        self.extensions = options.get("extensions", "xlsx,csv").split(",")
        self.item = options.get("item", SHEET_ITEM_COLUMN)
        self.drop = [c for c in options.get("drop", "\n".join(SHEET_DROP_COLUMNS)).split("\n") if c]
        self.bytes = int(options.get("partitionBytes", 4 << 20))

    def partitions(self) -> list[SheetPartition]:
        out, held = [SheetPartition([])], 0
        for m in list_members(self.path, self.extensions, self.archives):
            if out[-1].members and held + m.size > self.bytes:
                out.append(SheetPartition([]))
                held = 0
            out[-1].members.append(m)
            held += m.size
        return out

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        system, _ = file_system(self.path)
        for m in partition.members:
            # sheet_row 0 stands for the member itself
            rows.append((m.source, m.archive, None, None, m.size, 0, None, None, None, m.error))
            if m.error or _hidden(m.rel):
                continue
            try:
                for cell in self._cells(system, m):
                    rows.append(cell)
                    if len(rows) >= BATCH_CELLS:
                        yield _batch(rows)
                        rows = []
            except Exception as e:  # one bad sheet must not fail the run
                rows.append((m.source, m.archive, None, None, m.size, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield _batch(rows)

    def _cells(self, system, m: Member) -> Iterator[tuple]:
        low, parts = m.rel.lower(), [p for p in m.rel.split("/") if p]
        if not low.endswith((".xlsx", ".csv")):
            raise ValueError(f"unsupported file type: {m.rel}")
        city, prov = (parts[-2] if len(parts) >= 2 else None), (parts[-3] if len(parts) >= 3 else None)
        with system.open_input_file(m.archive or m.source) as f:
            if m.archive is not None:
                with zipfile.ZipFile(f) as z:
                    f = io.BytesIO(z.read(m.source))  # one workbook, which is a ZIP of its own
            rows = xlsx_rows(f) if low.endswith(".xlsx") else csv_rows(f)
            first = next(rows, None)
            if first is None:
                raise ValueError("empty sheet")
            header = [("" if h is None else str(h)).strip() for h in first]
            if self.item not in header:
                raise ValueError(f"missing column {self.item!r}")
            at = header.index(self.item)
            values = [(j, h) for j, h in enumerate(header) if j != at and h not in self.drop]
            for r, row in enumerate(rows, start=1):
                item = row[at] if at < len(row) else None
                for j, h in values:
                    yield (m.source, m.archive, prov, city, m.size, r, item, h, row[j] if j < len(row) else None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CELLS_SCHEMA.split(", ")])
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class SheetSource(DataSource):
    """Options: path; archives ("true": ZIP archives below it); extensions, comma-separated; item (name of
    the item column); drop (columns left out, one a line); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "price_sheets"

    def schema(self) -> str:
        return CELLS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(dict(self.options))


class Scan(NamedTuple):
    #: one row a cell
    cells: DataFrame
    #: files that could not be read: Source_File, archive, error
    failed: DataFrame
    #: every file or member listed: archive, member
    members: DataFrame


def scan(spark: SparkSession, path: str, archives: bool = False, extensions: Sequence[str] = ("xlsx", "csv"), item_col: str = SHEET_ITEM_COLUMN,
         drop: Sequence[str] = tuple(SHEET_DROP_COLUMNS), partition_bytes: int = 4 << 20) -> Scan:
    """Read every sheet below ``path`` once; cells, failures and names are views of the one checkpointed scan."""
    spark.dataSource.register(SheetSource)
    options = {"path": path, "archives": str(archives).lower(), "extensions": ",".join(extensions), "item": item_col,
               "drop": "\n".join(drop), "partitionBytes": str(partition_bytes)}
    rows = checkpoint(spark.read.format("price_sheets").options(**options).load())
    failed = rows.where(F.col("error").isNotNull()).select("Source_File", "archive", "error")
    cells = rows.where(F.col("error").isNull() & (F.col("sheet_row") > 0)).drop("error")
    listed = (F.col("sheet_row") == 0) & F.col("error").isNull()
    return Scan(cells, failed, rows.where(listed).select("archive", F.col("Source_File").alias("member")))


def scan_sheets(spark: SparkSession, path: str, extensions: Sequence[str] = ("xlsx", "csv"), item_col: str = SHEET_ITEM_COLUMN,
                drop: Sequence[str] = tuple(SHEET_DROP_COLUMNS)) -> tuple[DataFrame, DataFrame]:
    """Every sheet below ``path`` -> (cells, failed files).  Cells are
    long: (Source_File, Province, City, file_size, sheet_row, Commodity,
    header, cell)."""
    found = scan(spark, path, False, extensions, item_col, drop)
    return found.cells, found.failed


def scan_zip(spark: SparkSession, path: str, item_col: str = SHEET_ITEM_COLUMN,
             drop: Sequence[str] = tuple(SHEET_DROP_COLUMNS)) -> tuple[DataFrame, DataFrame]:
    """The same from ZIP archives (an optional single wrapper folder
    inside the archive is ignored)."""
    found = scan(spark, path, True, item_col=item_col, drop=drop)
    return found.cells, found.failed


# ------------------------------------------------------------------ P1, P2
def melt_sheet(wide: DataFrame, item_col: str = SHEET_ITEM_COLUMN, drop: Sequence[str] = tuple(SHEET_DROP_COLUMNS),
               meta: dict[str, str] | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Drop listed columns (if present), rename the item column to
    Commodity, add metadata columns (literals) and keep ``ids`` columns,
    unpivot the date columns -> (..., Date, Price)."""
    d = wide.drop(*[c for c in drop if c in wide.columns]).withColumnRenamed(item_col, "Commodity")
    for k, v in (meta or {}).items():
        d = d.withColumn(k, F.lit(v))
    ids = ["Commodity", *ids, *(meta or {}).keys()]
    vals = [c for c in d.columns if c not in ids]
    return d.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in vals]).unpivot(ids, vals, "Date", "Price")


def parse_dates(long: DataFrame, header: str = "Date") -> DataFrame:
    """Header text -> timestamp (``d/ M/ yyyy``, blanks collapsed);
    rows whose header does not parse are dropped; Year (text) and Month."""
    d = long.withColumn("Date", parse_header_date(header)).where(F.col("Date").isNotNull())
    return d.withColumn("Year", F.date_format("Date", "yyyy")).withColumn("Month", F.month("Date"))


def cells_to_panel(cells: DataFrame) -> DataFrame:
    """Scanned cells -> long panel (Commodity, City, Province, Source_File,
    Date, Price text, Year, Month)."""
    d = cells.select("Commodity", "City", "Province", "Source_File", F.col("header").alias("Date"), F.col("cell").alias("Price"))
    return parse_dates(d)


# ------------------------------------------------------------------ D1 - D3
def available_data(cells: DataFrame) -> DataFrame:
    """One row: sorted provinces and sorted years found in the headers."""
    y = F.year(parse_header_date("header"))
    return cells.agg(F.sort_array(F.collect_set("Province")).alias("provinces"), F.sort_array(F.collect_set(y)).alias("years"))


def file_catalog(cells: DataFrame, provinces: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """One row per file whose header years overlap the selection: city,
    province, file name, size, sorted years in the file, and the first
    matching year.  (A file is selected as a whole: it keeps all its years.)"""
    y = F.year(parse_header_date("header"))
    per = cells.groupBy("Source_File", "City", "Province", "file_size").agg(F.sort_array(F.collect_set(y)).alias("years_in_file"))
    if provinces:
        per = per.where(F.col("Province").isin(list(provinces)))
    sel = F.array(*[F.lit(int(v)) for v in years]) if years else F.col("years_in_file")
    hit = F.array_intersect("years_in_file", sel)
    return per.where(F.size(hit) > 0).select(
        "City", "Province", F.element_at(F.split("Source_File", "/"), -1).alias("filename"), F.col("file_size").alias("size"),
        "years_in_file", F.element_at(hit, 1).alias("year"), "Source_File")


def check_layout(members: DataFrame, cells: DataFrame | None = None, failed: DataFrame | None = None,
                 valid_cities: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """D3: every violation as (subject, check, detail): member path not
    ``[ROOT/]PROV/CITY/YYYY.xlsx``; unknown city; file that could not be
    read or lacks the item column; no date header; no numeric cell; item
    column all empty; date headers that pass the layout rule but do not
    parse (e.g. '01/01/2020')."""
    m = members.where(~F.col("member").rlike(r"(^|/)(__MACOSX|\.)") )
    bad_path = m.where(~F.col("member").rlike(LAYOUT_RE)).select(
        F.col("member").alias("subject"), F.lit("layout").alias("check"), F.lit("expected [ROOT/]PROVINCE/CITY/YYYY.xlsx").alias("detail"))
    out = bad_path
    if valid_cities is not None:
        if not isinstance(valid_cities, DataFrame):
            valid_cities = members.sparkSession.createDataFrame([(c,) for c in valid_cities], "City string")
        city = F.element_at(F.split("member", "/"), -2)
        unknown = m.where(F.col("member").rlike(LAYOUT_RE)).select("member", city.alias("City")).join(
            valid_cities.select("City"), "City", "left_anti")
        out = out.unionByName(unknown.select(F.col("member").alias("subject"), F.lit("unknown_city").alias("check"),
                                             F.col("City").alias("detail")))
    if failed is not None:
        out = out.unionByName(failed.select(F.col("Source_File").alias("subject"), F.lit("unreadable").alias("check"),
                                            F.col("error").alias("detail")))
    if cells is not None:
        is_date = F.trim("header").rlike(HEADER_RE)
        num = F.regexp_replace(F.trim("cell"), ",", "").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
        per = cells.groupBy("Source_File").agg(
            F.count_if(is_date).alias("_dates"),
            F.count_if(is_date & num).alias("_nums"),
            F.count_if(F.col("Commodity").isNotNull() & (F.trim("Commodity") != "")).alias("_items"),
            F.count_if(is_date & parse_header_date("header").isNull()).alias("_unparsed"),
        )
        for cond, check, detail in [
            (F.col("_dates") == 0, "no_date_columns", "no DD/ MM/ YYYY header"),
            (F.col("_nums") == 0, "no_numeric_data", "no numeric price cell"),
            (F.col("_items") == 0, "empty_item_column", "item column is empty"),
            (F.col("_unparsed") > 0, "unparseable_dates", "date headers without the blank after '/'"),
        ]:
            out = out.unionByName(per.where(cond).select(F.col("Source_File").alias("subject"), F.lit(check).alias("check"),
                                                         F.lit(detail).alias("detail")))
    return out
