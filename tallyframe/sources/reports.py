"""Datasets behind the reports, and how they are written.

A report is a folder with one dataset per table. Inputs are never overwritten:
an existing target is an error unless the caller says otherwise.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyframe.functions.columns import col
from tallyframe.functions.local import local_table
from tallyframe.operators.compare import (
    MISSING, MODIFIED, NEW, UNCHANGED, compare_summary, compare_tables,
)
from tallyframe.operators.dedupe import duplicate_report, duplicate_rows
from tallyframe.operators.profile import column_statistics, table_metadata
from tallyframe.operators.rules import validate, validation_report
from tallyframe.sources.files import POSITION_COLUMNS

FORMATS = ("parquet", "csv", "json", "orc")


def write_table(df, path, fmt="parquet", partition_by=(), mode="errorifexists"):
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format: {fmt!r}; expected one of {FORMATS}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_tables(tables, folder, fmt="parquet"):
    """Write ``{name: df}`` below ``folder``."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", fmt)


def metric_rows(one_row, metrics):
    """A one-row table as ``Metric, Value`` rows; ``metrics`` maps labels to columns."""
    pairs = [
        F.struct(F.lit(label).alias("Metric"), col(name).cast("string").alias("Value"))
        for label, name in metrics.items()
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def duplicate_tables(df, keys, order_by, keep="first", rank_by=None):
    """``Duplicate Rows`` and ``Summary``."""
    summary = metric_rows(
        duplicate_report(df, keys, keep),
        {
            "Columns Checked": "columns_checked",
            "Total Rows": "total_rows",
            "Duplicate Rows": "duplicate_rows",
            "Keep Strategy": "keep_strategy",
        },
    )
    return {"duplicate_rows": duplicate_rows(df, keys, order_by, keep, rank_by), "summary": summary}


# What the comparison's summary calls its figures.
COMPARISON_METRICS = {
    "Master File": "master",
    "Second File": "second",
    "Key Column(s)": "key_columns",
    "Matched Rows": "matched",
    "Missing In Second": "missing_in_second",
    "New In Second": "new_in_second",
    "Modified Rows": "modified",
}


def comparison_tables(master, second, keys, master_label="master", second_label="second", **options):
    """All differing rows, told apart by ``status``, and ``Summary``."""
    compared = compare_tables(master, second, keys, **options)
    summary = metric_rows(compare_summary(compared, keys, master_label, second_label), COMPARISON_METRICS)
    return {"differences": compared.where("status <> 'unchanged'"), "summary": summary}


def write_comparison(tables, folder, fmt="parquet"):
    """Differences are laid out by status, so each kind can be read on its own."""
    folder = folder.rstrip("/")
    write_table(tables["differences"], f"{folder}/differences", fmt, partition_by=["status"])
    write_table(tables["summary"], f"{folder}/summary", fmt)


def save_comparison(
    master, second, keys, folder, fmt="parquet", master_label="master", second_label="second", **options
):
    """The comparison report in one pass: figures are counted while the differences are written."""
    compared = compare_tables(master, second, keys, **options)
    counts = Observation()
    states = (MISSING, NEW, MODIFIED, UNCHANGED)
    seen = compared.observe(counts, *[F.count_if(F.col("status") == s).alias(s) for s in states])
    folder = folder.rstrip("/")
    write_table(seen.where(F.col("status") != UNCHANGED), f"{folder}/differences", fmt, partition_by=["status"])
    found = counts.get
    row = (
        master_label, second_label, ", ".join(keys), found[MODIFIED] + found[UNCHANGED], found[MISSING], found[NEW],
        found[MODIFIED],
    )
    schema = "master string, second string, key_columns string, matched long, missing_in_second long," \
        " new_in_second long, modified long"
    summary = metric_rows(local_table(master.sparkSession, [row], schema), COMPARISON_METRICS)
    write_table(summary, f"{folder}/summary", fmt)


def validation_tables(df, rules, row_id):
    """``Issues`` with 1-based rows for a 0-based ``row_id``, and ``Summary``."""
    issues = validate(df, rules, row_id).select(
        (F.col("row_id") + 1).alias("Row"),
        F.col("column").alias("Column"),
        F.col("rule_type").alias("Rule"),
        F.col("message").alias("Message"),
    )
    summary = metric_rows(
        validation_report(df, rules),
        {"Total Rows": "total_rows", "Rules Checked": "rules_checked", "Issues Found": "issues_found"},
    )
    return {"issues": issues, "summary": summary}


def batch_run_table(report):
    """The report of ``run_workflow_batch`` under its display names."""
    return report.select(
        F.col("source").alias("Source"),
        F.col("rows_before").alias("Rows Before"),
        F.col("rows_after").alias("Rows After"),
        F.col("status").alias("Status"),
        F.col("detail").alias("Detail"),
    )


def size_text(size_bytes):
    """A file size as shown to people: ``512 B``, ``1.5 KB``, ... up to TB."""
    steps = [("B", 0), ("KB", 1), ("MB", 2), ("GB", 3)]
    shown = F.format_string("%.1f TB", size_bytes / F.lit(float(1024**4)))
    for unit, power in reversed(steps):
        scaled = size_bytes / F.lit(float(1024**power))
        text = (
            F.format_string("%d B", size_bytes.cast("long"))
            if unit == "B"
            else F.format_string(f"%.1f {unit}", scaled)
        )
        shown = F.when(size_bytes < 1024 ** (power + 1), text).otherwise(shown)
    return shown


def profile_tables(df, order_by, columns=None):
    """``Summary`` and ``Column Statistics`` of a table."""
    visible = df.select(*[col(c) for c in (columns or df.columns) if c not in POSITION_COLUMNS])
    summary = metric_rows(
        table_metadata(visible),
        {
            "Row Count": "row_count",
            "Column Count": "column_count",
            "Duplicate Rows": "duplicate_rows",
            "Blank Cells": "blank_cells",
            "Fill Rate": "fill_rate_pct",
        },
    )
    return {
        "summary": summary,
        "column_statistics": column_statistics(df, order_by, visible.columns),
    }
