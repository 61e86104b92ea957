"""Consolidation of a folder of files, and the summary of one file."""

from pyspark.sql import functions as F

from tallyframe.errors import LoadError
from tallyframe.functions.columns import col
from tallyframe.operators.combine import IMPORT_TIMESTAMP, SOURCE_FILE, SOURCE_SHEET
from tallyframe.operators.profile import table_metadata
from tallyframe.sources.delimited import read_folder
from tallyframe.sources.files import POSITION_COLUMNS, SOURCE, list_files
from tallyframe.sources.reports import metric_rows, size_text


def consolidate_folder(spark, folder, import_timestamp):
    """``(table, log)``: all files with the folder's most common header, stamped.

    Unlike a union of one DataFrame per file, this is a single scan of the files.
    The log has a row per file of the folder and tells whether it was taken.
    """
    tables, log = read_folder(spark, folder)
    if not tables:
        raise LoadError(f"No readable csv or tsv file in {folder!r}")
    header, df = tables[0]
    stamped = df.select(
        *map(col, header),
        F.col(SOURCE).alias(SOURCE_FILE),
        F.lit("Sheet1").alias(SOURCE_SHEET),
        F.lit(import_timestamp).alias(IMPORT_TIMESTAMP),
    )
    chosen = F.col("header").eqNullSafe(F.array(*map(F.lit, header)))
    return stamped, log.withColumn("consolidated", chosen)


def file_summary(spark, path, df, sheet="Sheet1", sheet_count=1):
    """``Property, Value`` rows of a file and the table read from it."""
    listed = list_files(spark, path).agg(
        F.sum("size_bytes").alias("size"), F.max("modified").alias("modified")
    )
    visible = df.select(*[col(c) for c in df.columns if c not in POSITION_COLUMNS])
    about = listed.select(
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("name"),
        F.lit(sheet).alias("sheet"),
        F.lit(sheet_count).alias("sheets"),
        size_text(F.col("size")).alias("size"),
        F.coalesce(F.date_format("modified", "yyyy-MM-dd HH:mm"), F.lit("-")).alias("modified"),
    )
    of_file = metric_rows(
        about,
        {
            "File Name": "name",
            "Active Sheet": "sheet",
            "Sheet Count": "sheets",
            "File Size": "size",
            "Last Modified": "modified",
        },
    )
    of_table = metric_rows(
        table_metadata(visible),
        {
            "Row Count": "row_count",
            "Column Count": "column_count",
            "Duplicate Rows": "duplicate_rows",
            "Blank Cells": "blank_cells",
            "Fill Rate": "fill_rate_pct",
        },
    )
    return of_file.unionAll(of_table).select(F.col("Metric").alias("Property"), "Value")
