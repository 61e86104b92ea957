"""Workbooks (.xlsx, .xlsm): many files at once, one file per read, all sheets.

A workbook is a zip of XML parts and cannot be split, so Spark deals out whole
files by size and each task streams its files' rows out in batches, one open file
at a time. What reaches Spark is one row per sheet row; tables are then built by
header group like any other.
"""

import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.local import local_table
from tallyframe.sources.delimited import NA_TOKENS, tidy_header
from tallyframe.sources.files import WORKBOOK_SUFFIXES, open_file

ROW_SCHEMA = (
    "source_file string, sheet string, sheet_no int, is_hidden boolean, row_no long, "
    "kinds array<string>, cells array<string>, error string"
)
BATCH_ROWS = 5_000

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Numbers of the built-in cell formats that show a date or time,
# the first bytes of an encrypted or old binary workbook, and day zero.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
OLE_MAGIC = b"\xd0\xcf\x11\xe0"
DAY_ZERO = datetime(1899, 12, 30)
DAY_ZERO_1904 = datetime(1904, 1, 1)

TEXT, NUMBER, TRUTH, MOMENT = "s", "n", "b", "d"


def _column_index(reference):
    index = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        index = index * 26 + ord(letter) - 64
    return index - 1


def _xml(archive, name):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _joined_text(node):
    """Text of a shared or inline string; phonetic hints are not part of it."""
    parts = []
    for child in node:
        if child.tag == f"{MAIN}t":
            parts.append(child.text or "")
        elif child.tag == f"{MAIN}r":
            parts.extend(t.text or "" for t in child.findall(f"{MAIN}t"))
    return "".join(parts)


def _date_styles(styles):
    """Style numbers whose format shows a date or time."""
    if styles is None:
        return set()
    custom = set()
    for fmt in styles.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.IGNORECASE):
            custom.add(int(fmt.get("numFmtId")))
    formats = styles.find(f"{MAIN}cellXfs")
    numbers = [] if formats is None else [int(x.get("numFmtId", 0)) for x in formats]
    return {i for i, n in enumerate(numbers) if n in DATE_FORMAT_IDS or n in custom}


def _cell(node, shared, date_styles, day_zero):
    """``(kind, text)`` of a cell, or ``(None, None)`` if it is empty."""
    kind = node.get("t", "n")
    if kind == "inlineStr":
        inline = node.find(f"{MAIN}is")
        return (TEXT, _joined_text(inline)) if inline is not None else (None, None)
    value = node.find(f"{MAIN}v")
    if value is None or value.text is None:
        return None, None
    if kind == "s":
        return TEXT, shared[int(value.text)]
    if kind == "b":
        return TRUTH, "true" if value.text == "1" else "false"
    if kind == "e":
        return TEXT, value.text
    if kind == "d":
        return MOMENT, value.text
    if kind == "str":
        return TEXT, value.text
    if int(node.get("s", 0)) in date_styles:
        moment = day_zero + timedelta(days=float(value.text))
        return MOMENT, (moment + timedelta(microseconds=500)).isoformat(sep=" ", timespec="milliseconds")
    return NUMBER, value.text


def _sheet_rows(stream, shared, date_styles, day_zero):
    """``(row number, kinds, cells)`` per sheet row that has a filled cell."""
    position = -1
    for _, node in ElementTree.iterparse(stream):
        if node.tag != f"{MAIN}row":
            continue
        position = int(node.get("r", position + 2)) - 1
        kinds, cells = [], []
        for cell in node.iter(f"{MAIN}c"):
            reference = cell.get("r")
            index = _column_index(reference) if reference else len(cells)
            kind, text = _cell(cell, shared, date_styles, day_zero)
            if kind is None:
                continue
            kinds += [None] * (index + 1 - len(kinds))
            cells += [None] * (index + 1 - len(cells))
            kinds[index], cells[index] = kind, text
        node.clear()
        if cells:
            yield position, kinds, cells


def workbook_rows(path, file):
    """All rows of one workbook as tuples of ``ROW_SCHEMA``; a sheet without rows gives one."""
    if file.read(4) == OLE_MAGIC:
        raise ValueError("the workbook is password-protected or in the old binary format")
    file.seek(0)
    with zipfile.ZipFile(file) as archive:
        book = _xml(archive, "xl/workbook.xml")
        if book is None:
            raise ValueError("not a workbook")
        targets = {r.get("Id"): r.get("Target") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
        strings = _xml(archive, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_joined_text(s) for s in strings]
        date_styles = _date_styles(_xml(archive, "xl/styles.xml"))
        properties = book.find(f"{MAIN}workbookPr")
        old_days = properties is not None and properties.get("date1904") in ("1", "true")
        day_zero = DAY_ZERO_1904 if old_days else DAY_ZERO
        for number, sheet in enumerate(book.iter(f"{MAIN}sheet")):
            target = targets[sheet.get(RELATION)]
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            about = (path, sheet.get("name"), number, sheet.get("state", "visible") != "visible")
            empty = True
            with archive.open(part) as stream:
                for row, kinds, cells in _sheet_rows(stream, shared, date_styles, day_zero):
                    empty = False
                    yield (*about, row, kinds, cells, None)
            if empty:
                yield (*about, None, None, None, None)


def _read_workbooks(batches):
    import pandas as pd

    names = [field.split()[0] for field in ROW_SCHEMA.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            rows = []
            try:
                with open_file(path) as file:
                    for row in workbook_rows(path, file):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except (ValueError, KeyError, IndexError, OSError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                rows.append((path, None, None, None, None, None, None, f"Failed to read: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_workbook_rows(spark, path):
    """Every sheet row of the workbooks at ``path``; unreadable files give an error row."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = spark.read.format("binaryFile").load(path).where(suffix.isin(*WORKBOOK_SUFFIXES))
    paths = files.select(F.col("_metadata.file_path").alias("path"))
    return paths.mapInPandas(_read_workbooks, ROW_SCHEMA)


def workbook_log(rows):
    """Per sheet: visibility, emptiness, data rows and columns; per bad file: the error."""
    log = rows.groupBy("source_file", "sheet_no", "sheet", "is_hidden").agg(
        F.max("error").alias("error"),
        F.max("row_no").alias("last"),
        F.min("row_no").alias("first"),
        F.max(F.size("cells")).alias("columns"),
    )
    data_rows = F.coalesce(F.col("last") - F.col("first"), F.lit(0))
    return log.select(
        "source_file",
        "sheet",
        "sheet_no",
        F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"),
        "error",
        F.when(F.col("error").isNull(), data_rows).alias("rows"),
        F.when(F.col("error").isNull(), F.coalesce("columns", F.lit(0))).alias("columns"),
        "is_hidden",
        (F.col("error").isNull() & (data_rows == 0)).alias("is_empty"),
    )


def sheet_headers(rows):
    """Per sheet its header cells: the first filled row, padded to the widest row."""
    return (
        rows.where("error IS NULL AND row_no IS NOT NULL")
        .groupBy("source_file", "sheet_no", "sheet")
        .agg(
            F.min(F.struct("row_no", "cells")).alias("head"),
            F.max(F.size("cells")).alias("width"),
        )
        .select("source_file", "sheet_no", "sheet", F.col("head.row_no").alias("header_row"), "head.cells", "width")
    )


def sheet_groups(rows):
    """``[(header, [(file, sheet, sheet number, header row), ...]), ...]``, most sheets first."""
    groups = {}
    for sheet in sheet_headers(rows).orderBy("source_file", "sheet_no").collect():
        cells = [c or "" for c in sheet.cells] + [""] * (sheet.width - len(sheet.cells))
        groups.setdefault(tuple(tidy_header(cells)), []).append(
            (sheet.source_file, sheet.sheet, sheet.sheet_no, sheet.header_row)
        )
    return sorted(groups.items(), key=lambda item: len(item[1]), reverse=True)


def sheet_table(rows, header, sheets):
    """The data rows of some sheets with one header as a typed table.

    A column is numeric, boolean or a timestamp if all its filled cells are;
    otherwise it is text. Rows carry ``_source_file``, ``_source_sheet`` and
    ``_position``, the 0-based row below the header.
    """
    spark = rows.sparkSession
    wanted = local_table(
        spark,
        [(file, number, top) for file, _, number, top in sheets],
        "source_file string, sheet_no int, top long",
    )
    data = rows.join(wanted, ["source_file", "sheet_no"]).where("row_no > top")
    kind = {n: F.get("kinds", F.lit(i)) for i, n in enumerate(header)}
    cell = {}
    for i, name in enumerate(header):
        value = F.get("cells", F.lit(i))
        is_text = kind[name] == TEXT
        cell[name] = F.when(~(is_text & value.isin(*NA_TOKENS)), value)
    found = data.agg(
        *[
            F.collect_set(F.when(cell[n].isNotNull(), kind[n])).alias(f"k{i}")
            for i, n in enumerate(header)
        ],
        *[
            F.coalesce(F.bool_and(cell[n].rlike(r"^[+-]?\d{1,18}$")), F.lit(False)).alias(f"w{i}")
            for i, n in enumerate(header)
        ],
    ).first()
    columns = []
    for i, name in enumerate(header):
        kinds = set(found[f"k{i}"])
        if kinds <= {NUMBER}:
            dtype = T.LongType() if found[f"w{i}"] else T.DoubleType()
        elif kinds == {TRUTH}:
            dtype = T.BooleanType()
        elif kinds == {MOMENT}:
            dtype = T.TimestampNTZType()
        else:
            dtype = T.StringType()
        columns.append(cell[name].try_cast(dtype).alias(name))
    return data.select(
        *columns,
        F.col("source_file").alias("_source_file"),
        F.col("sheet").alias("_source_sheet"),
        (F.col("row_no") - F.col("top") - 1).alias("_position"),
    )


def read_workbooks(spark, path):
    """``(tables, log)`` of all workbooks at ``path``: one table per header group."""
    rows = read_workbook_rows(spark, path)
    tables = [(header, sheet_table(rows, header, sheets)) for header, sheets in sheet_groups(rows)]
    return tables, workbook_log(rows)
