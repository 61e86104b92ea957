"""Row filters, sorting and cell flags of a table view."""

from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import any_of, blank, col, text_of, value_of


def contains_text(df, needle, columns=None):
    """Predicate: the displayed text of any column contains ``needle``, case aside."""
    columns = list(columns or df.columns)
    require_columns(df, columns)
    return any_of(
        F.contains(F.lower(F.coalesce(text_of(df, c), F.lit(""))), F.lit(needle.lower()))
        for c in columns
    )


def search_rows(df, needle, columns=None):
    """Rows that show ``needle`` in any of the columns; all rows for an empty needle."""
    return df.where(contains_text(df, needle, columns)) if needle else df


def search_counts(df, needle, columns=None):
    """One row: rows shown by the filter and rows in total."""
    return df.agg(
        F.count_if(contains_text(df, needle, columns)).alias("shown_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def sort_rows(df, column, ascending=True, then_by=(), limit=None):
    """Sort by typed value, blanks lowest; ``then_by`` orders (and spreads) equal values.

    With ``limit`` only the top rows are kept, without a full sort.
    """
    require_columns(df, [column, *then_by])
    value = value_of(df, column)
    order = [value.asc_nulls_first() if ascending else value.desc_nulls_last()]
    ordered = df.orderBy(*order, *[col(c).asc_nulls_first() for c in then_by])
    return ordered if limit is None else ordered.limit(limit)


def mark_blanks(df, columns=None, suffix="_is_blank"):
    """Add a boolean column per column that is true where the cell is empty."""
    columns = list(columns or df.columns)
    require_some(columns, "The table has no columns.")
    require_columns(df, columns)
    return df.withColumns({f"{c}{suffix}": blank(df, c) for c in columns})
