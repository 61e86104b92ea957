"""Column and table profiles.

Cells are turned into ``(column number, text)`` pairs and counted per distinct
text first, so one shuffle of distinct values serves every figure of every
column, and a value that fills a third of a column is combined before it moves.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import (
    FLOATING, blank, col, dtype_of, is_numeric, percent, rounded_percent, value_of,
)
from tallyframe.functions.local import local_table

# How many examples are shown.
EXAMPLE_COUNT = 5
REPORT_EXAMPLE_COUNT = 3


def _cell(df, name):
    value = value_of(df, name)
    dtype = dtype_of(df, name)
    if isinstance(dtype, FLOATING):
        value = value + F.lit(0.0).cast(dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def cells_of(df, columns, place=()):
    cells = F.array(*[_cell(df, c) for c in columns])
    return df.select(*place, F.posexplode(cells).alias("ordinal", "value"))


def _distinct(df, columns, order_by=()):
    """Each column's distinct texts with their counts and, given an order, their first place."""
    if not order_by:
        return cells_of(df, columns).groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(*map(col, order_by)) if len(order_by) > 1 else col(order_by[0])
    return cells_of(df, columns, [place.alias("place")]).groupBy("ordinal", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("place")
    )


def of_column(columns, values):
    """Pick ``values[ordinal]`` for a column number."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("ordinal") + 1)


def profile_columns(df, columns=None, per_column=False):
    """One row per column: type, null, distinct and duplicate shares, lengths, range.

    Distinct counts are exact and ignore nulls; shares are percentages of all
    rows, rounded half-even to two digits; lengths are those of the displayed
    text; minimum and maximum are given for numeric columns only.

    By default ``df`` is computed once and all columns share one shuffle of texts.
    With ``per_column`` each column is scanned and grouped on its own, by typed
    value: cheaper for a bare parquet or orc table, where the scans together read
    no more than one, but not for rows that are parsed or computed first.
    """
    columns = list(columns or df.columns)
    require_some(columns, "The table has no columns.")
    require_columns(df, columns)
    numeric = [is_numeric(dtype_of(df, c)) for c in columns]
    if per_column:
        figures = [
            _column_figures(df, i, name, is_num)
            for i, (name, is_num) in enumerate(zip(columns, numeric))
        ]
        return _described(df, columns, numeric, reduce(lambda a, b: a.unionAll(b), figures))
    return _described(df, columns, numeric, _figures(_distinct(df, columns), columns, numeric))


def _figures(distinct, columns, numeric):
    present = F.col("value").isNotNull()
    number = F.when(of_column(columns, numeric), F.col("value").try_cast("double"))
    return distinct.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    )


def _column_figures(df, ordinal, name, numeric):
    simple = not isinstance(dtype_of(df, name), (T.ArrayType, T.MapType, T.StructType))
    distinct = df.groupBy((value_of(df, name) if simple else _cell(df, name)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    text = _cell(distinct, "value")
    number = F.col("value").cast("double") if numeric else F.lit(None).cast("double")
    return distinct.agg(
        F.lit(ordinal).alias("ordinal"),
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.min(F.length(text)).alias("min_length"),
        F.max(F.length(text)).alias("max_length"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    )


def profile_columns_approx(df, columns=None, rsd=0.02):
    """``profile_columns`` with estimated distinct counts: one pass, no value is shuffled."""
    columns = list(columns or df.columns)
    require_some(columns, "The table has no columns.")
    require_columns(df, columns)
    numeric = [is_numeric(dtype_of(df, c)) for c in columns]
    number = F.when(of_column(columns, numeric), F.col("value").try_cast("double"))
    figures = cells_of(df, columns).groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.approx_count_distinct("value", rsd).alias("unique_count"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
    )
    return _described(df, columns, numeric, figures)


def _described(df, columns, numeric, figures):
    spark = df.sparkSession
    names = local_table(
        spark,
        [
            (i, c, dtype_of(df, c).simpleString(), is_num)
            for i, (c, is_num) in enumerate(zip(columns, numeric))
        ],
        "ordinal int, column string, dtype string, is_numeric boolean",
    )
    return with_shares(names.join(figures, "ordinal", "left"))


def with_shares(figures):
    """The profile's columns from counts, lengths and ranges per column; without counts, those of an empty table."""
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    nulls = F.coalesce("null_count", F.lit(0)).cast("long")
    uniques = F.coalesce("unique_count", F.lit(0)).cast("long")
    repeats = F.greatest(rows - nulls - uniques, F.lit(0))
    return figures.select(
        "ordinal",
        "column",
        "dtype",
        rows.alias("row_count"),
        nulls.alias("null_count"),
        rounded_percent(nulls, rows, 2).alias("null_pct"),
        uniques.alias("unique_count"),
        rounded_percent(uniques, rows, 2).alias("unique_pct"),
        rounded_percent(repeats, rows, 2).alias("duplicate_pct"),
        F.col("min_length").cast("long").alias("min_length"),
        F.col("max_length").cast("long").alias("max_length"),
        "min_value",
        "max_value",
        "is_numeric",
    )


def first_examples(distinct, count, group):
    """The ``count`` rows of each group that come first by ``place``; a task passes on ``count`` per group."""
    first = Window.partitionBy(*group).orderBy("place")
    return distinct.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)


def _examples(distinct, count):
    """``ordinal, examples``: each column's first distinct texts."""
    texts = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return first_examples(distinct.where("value IS NOT NULL"), count, ["ordinal"]).groupBy("ordinal").agg(
        F.transform(texts, lambda cell: cell["value"]).alias("examples")
    )


def example_values(df, order_by, columns=None, count=EXAMPLE_COUNT):
    """Per column the first ``count`` distinct texts of the whole column, in row order."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = list(columns or [c for c in df.columns if c not in order_by])
    require_some(order_by, "Name the columns that order the rows (order_by).")
    require_columns(df, [*columns, *order_by])
    lists = _examples(_distinct(df, columns, order_by), count)
    names = local_table(df.sparkSession, list(enumerate(columns)), "ordinal int, column string")
    empty = F.array().cast("array<string>")
    return names.join(lists, "ordinal", "left").select(
        "ordinal", "column", F.coalesce("examples", empty).alias("examples")
    )


def column_statistics(df, order_by, columns=None):
    """The column report: type, shares, range and up to three examples per column.

    Figures and examples come from one shuffle of distinct texts, which Spark reuses.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = list(columns or df.columns)
    require_some(columns, "The table has no columns.")
    require_columns(df, [*columns, *order_by])
    numeric = [is_numeric(dtype_of(df, c)) for c in columns]
    distinct = _distinct(df, columns, order_by)
    profile = _described(df, columns, numeric, _figures(distinct, columns, numeric))
    examples = _examples(distinct, REPORT_EXAMPLE_COUNT)
    return profile.join(examples, "ordinal", "left").select(
        "ordinal",
        F.col("column").alias("Column"),
        F.col("dtype").alias("Type"),
        F.col("null_pct").alias("Null %"),
        F.col("unique_pct").alias("Unique %"),
        F.col("duplicate_pct").alias("Duplicate %"),
        F.col("min_value").alias("Min"),
        F.col("max_value").alias("Max"),
        F.array_join(F.coalesce("examples", F.array().cast("array<string>")), ", ").alias("Example Values"),
    )


def null_shares(df, columns=None):
    """``column, null_pct`` per column from a single aggregation."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.count_if(blank(df, c)) for c in columns]).alias("nulls"),
    )
    names = F.array(*map(F.lit, columns))
    return counted.select(
        "rows", F.posexplode(F.arrays_zip(names.alias("column"), F.col("nulls"))).alias("ordinal", "c")
    ).select(
        "ordinal",
        F.col("c.column").alias("column"),
        rounded_percent(F.col("c.nulls"), F.col("rows"), 2).alias("null_pct"),
    )


def table_metadata(df):
    """One row: rows, columns, repeated rows, blank cells and fill rate in %.

    Equal rows are counted first; everything else follows from those counts.
    """
    blanks = sum((blank(df, c).cast("long") for c in df.columns), F.lit(0).cast("long"))
    prepared = df.select(*[value_of(df, c).alias(c) for c in df.columns], blanks.alias("__blanks"))
    distinct = prepared.groupBy(*map(col, df.columns), "__blanks").agg(F.count(F.lit(1)).alias("__n"))
    width = len(df.columns)
    totals = distinct.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("__n") * F.col("__blanks")), F.lit(0)).alias("blank_cells"),
    )
    cells = F.col("rows") * width
    return totals.select(
        F.col("rows").alias("row_count"),
        F.lit(width).cast("long").alias("column_count"),
        "duplicate_rows",
        "blank_cells",
        F.bround(percent(cells - F.col("blank_cells"), cells), 1).cast("double").alias("fill_rate_pct"),
    )
