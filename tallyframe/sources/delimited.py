"""Delimited text: header handling, missing-value tokens, type inference, folders."""

import csv
import io
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.errors import LoadError, require_some
from tallyframe.functions.columns import col
from tallyframe.functions.local import local_table
from tallyframe.functions.parsing import is_number_text
from tallyframe.sources.files import (
    BLOCK, POSITION, POSITION_COLUMNS, SEPARATORS, SOURCE, list_files, readable_path, require_suffix, suffix_of,
    with_position,
)
from tallyframe.sources.records import ends_open, field_count, parse, regroup

# Cell texts that mean "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cell texts that are truth values.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

HEADER_SCHEMA = "path string, header array<string>, error string"


def tidy_header(cells):
    """Column names as read: blanks become ``Unnamed: n``, repeats get ``.1``, ``.2``, ...

    Names that differ in case alone are repeats too, since Spark would not tell them apart.
    """
    names, seen = [], set()
    for position, cell in enumerate(cells):
        base = cell if cell.strip() else f"Unnamed: {position}"
        name, copy = base, 0
        while name.lower() in seen:
            copy += 1
            name = f"{base}.{copy}"
        seen.add(name.lower())
        names.append(name)
    return names


def separator_of(path):
    """A column: the field separator that a file's suffix stands for, or null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix == ".csv", ",").when(suffix == ".tsv", "\t")


def scan_lines(spark, paths, sep=None):
    """``path, first_line, spans_lines, widths`` per file, from one scan of lines.

    ``spans_lines``: a quoted field is left open at the end of some line, so records are more than lines.
    ``widths`` counts the lines of each number of fields. Lines are combined before anything is
    shuffled, and files without any line have no row.
    """
    lines = with_position(spark.read.text(paths)).where("trim(value) <> ''")
    line, known = F.col("value"), F.lit(sep) if sep else separator_of(F.col(SOURCE))
    lines = lines.select(SOURCE, BLOCK, POSITION, "value", known.alias("sep")).where("sep IS NOT NULL")

    def by_separator(of):
        kinds = [sep] if sep else SEPARATORS.values()
        return F.coalesce(*[F.when(F.col("sep") == kind, of(line, kind)) for kind in kinds])

    lines = lines.select(
        SOURCE, F.struct(BLOCK, POSITION).alias("at"), "value", by_separator(field_count).alias("width"),
        by_separator(ends_open).alias("open"),
    )
    counted = lines.groupBy(SOURCE, "width").agg(
        F.count(F.lit(1)).alias("lines"), F.max("open").alias("open"), F.min_by("value", "at").alias("value"),
        F.min("at").alias("at"),
    )
    return counted.groupBy(F.col(SOURCE).alias("path")).agg(
        F.min_by("value", "at").alias("first_line"), F.max("open").alias("spans_lines"),
        F.map_from_entries(F.collect_list(F.struct("width", "lines"))).alias("widths"),
    )


def _parse_headers(batches):
    """Column names from each file's first line; runs in tasks on lines, whatever store they are from."""
    import pandas as pd

    for batch in batches:
        rows = []
        for path, sep, line in zip(batch["path"], batch["sep"], batch["first_line"]):
            if line is None or not line.strip("\ufeff \t"):
                rows.append((path, None, "No columns to parse from file"))
                continue
            line = line.removeprefix("\ufeff")
            try:
                list(csv.reader(io.StringIO(line, newline=""), delimiter=sep, strict=True))
            except csv.Error as error:
                if "end of data" in str(error):
                    rows.append((path, None, "The header record spans lines"))
                    continue
            cells = next(csv.reader(io.StringIO(line, newline=""), delimiter=sep))
            rows.append((path, tidy_header(cells), None))
        yield pd.DataFrame(rows, columns=["path", "header", "error"])


def file_headers(spark, folder):
    """One row per csv or tsv file: ``path, size_bytes, modified, header, error, spans_lines, short_rows``.

    A file with a row of more fields than its header is an error, as a cell would be lost. ``short_rows``
    counts rows with fewer; their missing cells are null.
    """
    listed = list_files(spark, folder).withColumn("sep", separator_of(F.col("path"))).where("sep IS NOT NULL")
    paths = [readable_path(row.path) for row in listed.where("size_bytes > 0").select("path").collect()]
    if paths:
        lines = scan_lines(spark, paths)
        listed = listed.join(lines, "path", "left")
    else:
        listed = listed.selectExpr(
            "*", "CAST(NULL AS STRING) first_line", "false spans_lines", "CAST(map() AS map<int, long>) widths"
        )
    schema = HEADER_SCHEMA
    headers = listed.select("path", "sep", "first_line").mapInPandas(_parse_headers, schema)
    found = listed.drop("sep", "first_line").join(headers, "path")
    return found.select(
        "path", "size_bytes", "modified", "header",
        F.when(F.coalesce("spans_lines", F.lit(False)), F.col("error")).otherwise(
            F.coalesce("error", _surplus_error(_rows_where("header", ">")))
        ).alias("error"),
        F.coalesce("spans_lines", F.lit(False)).alias("spans_lines"),
        F.when(~F.coalesce("spans_lines", F.lit(False)), _rows_where("header", "<")).alias("short_rows"),
    )


def _rows_where(header, compare):
    """Lines with fewer (or more) fields than the header; these are rows where no field spans lines."""
    entries = F.map_entries("widths")
    size = F.size(header)
    fits = (lambda e: e["key"] < size) if compare == "<" else (lambda e: e["key"] > size)
    total = F.aggregate(F.filter(entries, fits), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return F.coalesce(total, F.lit(0))


def _surplus_error(rows):
    return F.when(rows > 0, F.concat(rows.cast("string"), F.lit(" row(s) have more fields than the header")))


def header_group_counts(headers):
    """Folder header groups: ``columns, files``, for a table of ``file_headers``."""
    return headers.where("error IS NULL").groupBy("header").agg(F.count(F.lit(1)).alias("files"))


def _faults(records, unclosed, header):
    """``path, error`` of the files among regrouped ones that cannot be read."""
    surplus = records.where(F.col("fields") > len(header)).groupBy(F.col(SOURCE).alias("path")).agg(F.count("*").alias("n"))
    faults = surplus.select("path", _surplus_error(F.col("n")).alias("error"))
    return faults.unionAll(unclosed.select("path", F.lit("A quoted field is never closed").alias("error")))


def _scan_records(records, header, sep, corrupt_column=None):
    return _without_missing(parse(records, header, sep, corrupt_column), header, corrupt_column)


def _scan(spark, paths, header, sep, corrupt_column=None):
    """Files in which every line is a record."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        # Spark's own limit of columns is below what a header may hold.
        .option("maxColumns", max(20_480, len(header) + 16))
        .option("mode", "PERMISSIVE")
    )
    if corrupt_column:
        schema = schema.add(corrupt_column, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return _without_missing(with_position(reader.schema(schema).csv(paths)), header, corrupt_column)


def _without_missing(rows, header, corrupt_column):
    extra = [corrupt_column] if corrupt_column else []
    return rows.select(
        *[F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in header],
        *map(col, [*extra, *POSITION_COLUMNS]),
    )


# One bit per form a cell can take; a column's form is the union of its cells' bits.
WHOLE, LONG_WHOLE, DECIMAL, TRUTH, OTHER = 1, 2, 4, 8, 16


def _form(cell):
    # Patterns come before casts: a cast that fails costs an exception per cell.
    whole = cell.rlike(r"^\s*[+-]?\d+\s*$")
    fits = (F.length(cell) < 19) | cell.try_cast("bigint").isNotNull()
    return (
        F.when(cell.isNull(), F.lit(None).cast("int"))
        .when(whole, F.when(fits, WHOLE).otherwise(LONG_WHOLE))
        .when(is_number_text(cell), DECIMAL)
        .when(cell.isin(*TRUE_TOKENS, *FALSE_TOKENS), TRUTH)
        .otherwise(OTHER)
    )


def _types(names, forms):
    types = {}
    for name, form in zip(names, forms):
        if form is None or (form & DECIMAL and not form & ~(WHOLE | LONG_WHOLE | DECIMAL)):
            types[name] = T.DoubleType()
        elif form == WHOLE:
            types[name] = T.LongType()
        elif form == TRUTH:
            types[name] = T.BooleanType()
        else:
            types[name] = T.StringType()
    return types


def _forms(names):
    return [F.bit_or(_form(col(n))).alias(f"f{i}") for i, n in enumerate(names)]


def infer_types(df, names):
    """The narrowest of bigint, double, boolean, string that holds every filled cell.

    One aggregation over all columns. Dates stay text; whole numbers too long for
    a bigint stay text as well; a column without any cell is double.
    """
    require_some(names, "The table has no columns.")
    return _types(names, df.agg(*_forms(names)).first())


def typed_by_file(df, names):
    """``[(types, df), ...]``: the rows of the files whose cells have the same types, typed.

    Every file gets the types of its own cells. One aggregation by file; the driver sees the kinds of
    types that occur, not the files.
    """
    kinds = [f"k{i}" for i in range(len(names))]
    by_file = df.groupBy(F.col(SOURCE).alias("__file")).agg(*_forms(names))
    # Forms that come to the same type are one kind.
    simple = {f"k{i}": _kind(F.col(f"f{i}")) for i in range(len(names))}
    by_file = by_file.select("__file", *[c.alias(k) for k, c in simple.items()])
    by_file = by_file.withColumn("__kind", F.concat_ws(",", *kinds)).select("__file", "__kind")
    tables = []
    for row in by_file.select("__kind").distinct().orderBy("__kind").collect():
        types = dict(zip(names, (KINDS[k]() for k in row[0].split(","))))
        files = by_file.where(F.col("__kind") == row[0])
        rows = df.join(files, F.col(SOURCE) == F.col("__file")).select(*map(col, df.columns))
        tables.append((types, apply_types(rows, types)))
    return tables


KINDS = {"d": T.DoubleType, "l": T.LongType, "b": T.BooleanType, "s": T.StringType}


def _kind(form):
    decimal = (form.bitwiseAND(DECIMAL) > 0) & (form.bitwiseAND(TRUTH | OTHER) == 0)
    return (
        F.when(form.isNull() | decimal, "d").when(form == WHOLE, "l").when(form == TRUTH, "b").otherwise("s")
    )


def apply_types(df, types):
    """Cast text columns; a cell that does not fit its type becomes null."""

    def typed(name):
        dtype = types[name]
        if isinstance(dtype, T.StringType):
            return col(name)
        return col(name).try_cast(dtype).alias(name)

    return df.select(*[typed(c) if c in types else col(c) for c in df.columns])


def _first_records(spark, paths, sep):
    """Column names of each file, and the files whose quoted fields span lines."""
    try:
        lines = scan_lines(spark, paths, sep)
        rows = lines.select("path", F.lit(sep).alias("sep"), "first_line", "spans_lines", "widths")
        headers = rows.mapInPandas(_parse_headers, HEADER_SCHEMA)
        found = rows.join(headers, "path").select(
            "path", "header", "error", "spans_lines", _surplus_error(_rows_where("header", ">")).alias("surplus")
        ).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(", ".join(paths)) from error
        raise
    if not found:
        raise LoadError(f"Failed to read {paths[0]!r}: No columns to parse from file")
    return sorted(found, key=lambda row: row.path)


def read_delimited(
    spark, path, *, sep=None, infer=True, types=None, multi_line=None, corrupt_column=None
):
    """A csv or tsv file, or several with one header, as a typed table.

    Row positions are in ``_source_file, _block_start, _position``. Pass ``types``
    (name to Spark type) to skip the inference scan. Files whose quoted fields hold line
    breaks are found and regrouped into records, by blocks; ``multi_line`` says that all
    files (or none) are such files. Files whose headers differ, rows with more fields than the
    header, and quoted fields that are never closed are errors; with ``corrupt_column`` rows of
    more fields are kept there as text. Rows with fewer fields are filled with nulls.
    """
    paths = [path] if isinstance(path, str) else list(path)
    require_some(paths, "At least one file is required.")
    for p in paths:
        if sep is None:
            require_suffix(p, SEPARATORS)
    sep = sep or SEPARATORS[suffix_of(paths[0])]
    files = _first_records(spark, paths, sep)
    headers, whole, split = {}, [], []
    for row in files:
        spans = row.spans_lines if multi_line is None else multi_line
        (whole if spans else split).append(readable_path(row.path))
        if spans:
            continue
        # With a column for broken lines, rows of more fields are kept there.
        fault = row.error or (None if corrupt_column else row.surplus)
        if fault:
            raise LoadError(f"Failed to read {row.path!r}: {fault}")
        headers.setdefault(tuple(row.header), row.path)
    if whole:
        records, first, unclosed = regroup(spark, whole, sep)
        for row in unclosed.orderBy("path").take(1):
            raise LoadError(f"Failed to read {row.path!r}: A quoted field is never closed")
        first = first.select("path", F.lit(sep).alias("sep"), F.col("record").alias("first_line"))
        for row in first.mapInPandas(_parse_headers, HEADER_SCHEMA).orderBy("path").collect():
            headers.setdefault(tuple(row.header), row.path)
    if len(headers) > 1:
        raise LoadError(f"The files have different headers: {dict((p, list(h)) for h, p in headers.items())}")
    header, parts = list(next(iter(headers))), []
    if whole:
        faults = [] if corrupt_column else _faults(records, unclosed, header).orderBy("path").take(1)
        for fault in faults:
            raise LoadError(f"Failed to read {fault.path!r}: {fault.error}")
        parts.append(_scan_records(records, header, sep, corrupt_column))
    if split:
        parts.append(_scan(spark, split, header, sep, corrupt_column))
    df = reduce(lambda a, b: a.unionAll(b), parts)
    if types is None and not infer:
        return df
    return apply_types(df, types or infer_types(df, header))


def read_folder(spark, folder, *, infer=True, types=None, multi_line=None, by_file=False):
    """``(tables, log)`` of every csv and tsv file directly in a folder.

    ``tables`` is ``[(header, df), ...]``, one per distinct header, most files
    first; a folder of any number of files is scanned as that many DataFrames.
    With ``by_file`` every file is typed by its own cells, and files of one header
    and types make a table. ``log`` has a row per file of the folder: status
    (``ok``, ``failed``, or ``skipped`` for other suffixes), error, rows, rows with
    fewer fields than the header, columns, size, time, header.
    """
    headers = file_headers(spark, folder)
    separators = {known[1:]: known for known in SEPARATORS}
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    # The lists of files to scan, which Spark's reader keeps on the driver as well.
    groups = (
        headers.where("error IS NULL")
        .groupBy("header", "spans_lines", suffix.alias("suffix"))
        .agg(F.collect_list("path").alias("paths"))
        .collect()
    )
    scans, faults = {}, []
    for group in sorted(groups, key=lambda g: (min(g.paths), g.spans_lines)):
        paths = [readable_path(p) for p in sorted(group.paths)]
        sep = SEPARATORS[separators[group.suffix]]
        if group.spans_lines if multi_line is None else multi_line:
            records, _, unclosed = regroup(spark, paths, sep)
            faulty = _faults(records, unclosed, group.header)
            faults.append(faulty)
            good = records.join(faulty, F.col(SOURCE) == F.col("path"), "left_anti")
            scan = _scan_records(good, group.header, sep)
        else:
            scan = _scan(spark, paths, group.header, sep)
        scans.setdefault(tuple(group.header), []).append((paths, scan))
    order = sorted(scans, key=lambda h: (-sum(len(p) for p, _ in scans[h]), min(min(p) for p, _ in scans[h])))
    tables, counts = [], local_table(spark, [], f"{SOURCE} string, rows long")
    for header in order:
        df = reduce(lambda a, b: a.unionAll(b), [scan for _, scan in scans[header]])
        counts = counts.unionAll(df.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("rows")))
        if types is None and infer and by_file:
            tables += [(header, typed) for _, typed in typed_by_file(df, list(header))]
            continue
        if types is not None or infer:
            df = apply_types(df, types or infer_types(df, list(header)))
        tables.append((header, df))
    if faults:
        faulty = reduce(lambda a, b: a.unionAll(b), faults).withColumnRenamed("error", "fault")
        headers = headers.join(faulty, "path", "left").withColumn("error", F.coalesce("error", "fault"))
    readable = F.col("error").isNull()
    log = headers.join(counts, F.col("path") == F.col(SOURCE), "left").select(
        F.col("path").alias("source_file"),
        F.lit("Sheet1").alias("sheet"),
        F.when(readable, "ok").otherwise("failed").alias("status"),
        "error",
        F.when(readable, F.coalesce("rows", F.lit(0))).alias("rows"),
        F.when(readable, F.col("short_rows")).alias("short_rows"),
        F.when(readable, F.size("header")).alias("columns"),
        "size_bytes",
        "modified",
        "header",
    )
    others = list_files(spark, folder).where(separator_of(F.col("path")).isNull())
    skipped = others.select(
        F.col("path").alias("source_file"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit("skipped").alias("status"),
        F.concat(F.lit("no reader for suffix "), F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("error"),
        F.lit(None).cast("long").alias("rows"),
        F.lit(None).cast("long").alias("short_rows"),
        F.lit(None).cast("int").alias("columns"),
        "size_bytes",
        "modified",
        F.lit(None).cast("array<string>").alias("header"),
    )
    return tables, log.unionByName(skipped)
