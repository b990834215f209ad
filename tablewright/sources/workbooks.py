"""Workbooks (.xlsx, .xlsm) as rows.

A workbook is one zip file and is parsed by one task, streaming over its cells;
Spark spreads the workbooks of a folder over the cluster. The result is a long
table (workbook, sheet, row_number, cells), which :func:`sheet_table` turns into
columns by one header; :func:`folder_table` lays each sheet's own header over its rows.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions import parse
from tablewright.sources.naming import column_names

ROWS_SCHEMA = "workbook string, sheet string, row_number int, cells array<string>"
ROWS_PER_BATCH = 5000

# Names of the spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_workbooks(
    spark: SparkSession, folder: str, sheet: str | None = None, skip_rows: int = 0
) -> DataFrame:
    """Rows of the first sheet (or the named one, or all with '*') of every workbook in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(folder)
    return parse_workbooks(files.select(F.col("path").alias("workbook"), "content"), sheet, skip_rows)


def parse_workbooks(files: DataFrame, sheet: str | None = None, skip_rows: int = 0) -> DataFrame:
    """Parse a (workbook, content) table."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["workbook"], batch["content"]):
                yield from _frames(name, content, sheet, skip_rows)

    return files.select("workbook", "content").mapInPandas(parse, ROWS_SCHEMA)


def _frames(name: str, content: bytes, sheet: str | None, skip_rows: int) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates, epoch = _shared_strings(book), _date_styles(book), _epoch(book)
        for title, part in _sheets(book, sheet):
            rows = []
            for number, cells in _rows(book, part, shared, dates, epoch):
                if number > skip_rows:
                    rows.append((name, title, number - skip_rows, cells))
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=["workbook", "sheet", "row_number", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row_number", "cells"])


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


# Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """The cell styles that show a number as a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode") or "" for f in root.iter(f"{MAIN}numFmt")}
    styles = root.find(f"{MAIN}cellXfs")
    found = set()
    for i, style in enumerate(styles if styles is not None else []):
        number = style.get("numFmtId") or "0"
        # What stands in quotes, brackets or behind a backslash is shown as it is.
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, ""))
        if (number in own and re.search("[ymdhs]", shown, re.IGNORECASE)) or (number not in own and int(number) in _DATE_FORMATS):
            found.add(str(i))
    return found


def _epoch(book: zipfile.ZipFile) -> datetime.datetime:
    """Day 0 of the workbook's dates."""
    properties = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
    later = properties is not None and properties.get("date1904") in ("1", "true")
    return datetime.datetime(1904, 1, 1) if later else datetime.datetime(1899, 12, 30)


def _date_text(serial: str, epoch: datetime.datetime) -> str:
    """A date's number of days as ISO text; what is no such number stays."""
    try:
        moment = epoch + datetime.timedelta(seconds=round(float(serial) * 86_400))
    except (ValueError, OverflowError):
        return serial
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ")


def _sheets(book: zipfile.ZipFile, wanted: str | None) -> list[tuple[str, str]]:
    targets = {
        rel.get("Id"): rel.get("Target")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    found = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[s.get(RELATION)]
        found.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    if wanted is None:
        return found[:1]
    return found if wanted == "*" else [f for f in found if f[0] == wanted]


def _column_index(reference: str) -> int:
    """'A1' -> 0, 'AB7' -> 27."""
    index = 0
    for ch in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(ch) - ord("A") + 1
    return index - 1


def _rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[str], epoch: datetime.datetime) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag != f"{MAIN}row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in node.iter(f"{MAIN}c"):
                at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (at + 1 - len(cells)))
                text = _cell_text(cell, shared)
                dated = text is not None and cell.get("s") in dates and cell.get("t", "n") == "n"
                cells[at] = _date_text(text, epoch) if dated else text
            yield number, cells
            node.clear()


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


def sheet_table(rows: DataFrame, header: list[str], columns: list[str] | None = None) -> DataFrame:
    """The data rows below the header as text columns with normalised names.

    ``columns`` keeps only the named header fields that exist.
    """
    kept = [i for i, h in enumerate(header) if columns is None or h in columns] or list(range(len(header)))
    names = column_names([header[i] for i in kept])
    cells = [F.get("cells", F.lit(i)).alias(n) for i, n in zip(kept, names)]
    return rows.where(F.col("row_number") > 1).select("workbook", "sheet", *cells)


def sheet_header(rows: DataFrame) -> list[str]:
    """The header of the first workbook and sheet."""
    return rows.where(F.col("row_number") == 1).orderBy("workbook", "sheet").first()["cells"]


def _headers(rows: DataFrame) -> DataFrame:
    """(workbook, sheet, names): each sheet's normalised header, as wide as its widest row."""
    widths = rows.groupBy("workbook", "sheet").agg(F.max(F.size("cells")).alias("width"), F.max(F.when(F.col("row_number") == 1, F.col("cells"))).alias("cells"))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            headers = [[] if cells is None else list(cells) for cells in batch["cells"]]
            names = [column_names([*h, *[None] * (int(w) - len(h))]) for h, w in zip(headers, batch["width"])]
            yield batch[["workbook", "sheet"]].assign(names=names)

    return widths.mapInPandas(named, "workbook string, sheet string, names array<string>")


def folder_table(rows: DataFrame, typed: bool = True) -> DataFrame:
    """The data rows of all sheets by name: workbook, sheet, then every column that some header has.

    Each sheet's own header names its cells, so sheets may order their columns in any way; a column that a sheet
    lacks is null there, and cells beyond the header become unnamed columns. Columns come by their first place, then
    name. With ``typed`` a column of which every value is a number or a date becomes one.
    """
    headers = _headers(rows)
    placed = headers.select(F.posexplode("names").alias("place", "name")).groupBy("name").agg(F.min("place").alias("place"))
    columns = [r["name"] for r in placed.orderBy("place", "name").collect()]  # one row per column
    named = rows.where(F.col("row_number") > 1).join(headers, ["workbook", "sheet"])
    cells = [F.get("cells", F.array_position("names", F.lit(c)).cast("int") - 1).alias(f"cell_{i}") for i, c in enumerate(columns)]
    table = named.select("workbook", "sheet", *cells)
    kinds = _kinds(table, len(columns)) if typed and columns else {}
    out = [_typed(F.col(f"cell_{i}"), kinds.get(i)).alias(c) for i, c in enumerate(columns)]
    return table.select("workbook", "sheet", *out)


def _kinds(table: DataFrame, count: int) -> dict[int, str]:
    """The type of each column whose values are all numbers or all dates, from one scan."""
    entries = []
    for i in range(count):
        value, digits = F.col(f"cell_{i}"), parse.number_text(F.col(f"cell_{i}"))
        facts = {"present": F.count(value), "numbers": F.count(digits), "dates": F.count(parse.parse_timestamp(value)), **parse.digit_facts(digits)}
        entries.append(F.struct(*[f.alias(k) for k, f in facts.items()]).alias(f"c{i}"))
    row = table.agg(*entries).first()
    kinds = {}
    for i in range(count):
        facts = row[f"c{i}"].asDict()
        if facts["present"] and facts["numbers"] == facts["present"]:
            whole = not facts["scale"] and not facts["exponents"] and facts["whole"] <= parse.LONG_DIGITS
            kind = "bigint" if whole else parse.exact_type(facts)
            kinds |= {i: kind} if kind else {}
        elif facts["present"] and facts["dates"] == facts["present"]:
            kinds[i] = "date"
    return kinds


def _typed(c: Column, kind: str | None) -> Column:
    if kind is None:
        return c
    return parse.parse_timestamp(c) if kind == "date" else parse.number_text(c).try_cast(kind)
