"""Duplicates by key: mask, removal with a keep strategy, and counts.

Rows are ordered by ``order_by``, which must be unique within a key (the ingest
row id, or any column list that identifies a row). Nulls are equal to each other.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_free, require_some
from tallyframe.functions.columns import (
    INTEGRAL, all_of, col, dtype_of, is_numeric, match_key, rounded_percent, value_of,
)
from tallyframe.operators.skew import hot_keys

KEEP_STRATEGIES = ("first", "last", "highest")


def _check(df, keys, order_by, keep):
    require_some(keys, "Duplicates need at least one key column.")
    require_columns(df, [*keys, *order_by])
    if keep not in KEEP_STRATEGIES:
        raise ValueError(f"keep={keep!r} is none of {KEEP_STRATEGIES}")


def _names(value):
    return [value] if isinstance(value, str) else list(value)


def _keys(df, keys):
    return [match_key(df, k, df.schema[k].dataType) for k in keys]


def pick_rank_column(df, keys, order_by=()):
    """The first numeric column, in schema order, that is neither key nor row order."""
    for field in df.schema:
        if field.name not in (*keys, *order_by) and is_numeric(field.dataType):
            return field.name
    return None


def _keep_order(df, keys, order_by, keep, rank_by):
    """Sort columns that put the row to keep first within its key."""
    if keep == "last":
        return [col(c).desc_nulls_last() for c in order_by]
    order = [col(c).asc_nulls_first() for c in order_by]
    if keep == "highest":
        rank = rank_by or pick_rank_column(df, keys, order_by)
        if rank is not None:
            require_columns(df, [rank], "Rank column")
            order.insert(0, value_of(df, rank).desc_nulls_last())
    return order


def _kept(df, keys, order_by, keep, rank_by):
    # Spark turns "row_number() = 1" into a group limit that runs before the
    # shuffle as well, so each map task sends at most one row per key.
    first = Window.partitionBy(*_keys(df, keys)).orderBy(
        *_keep_order(df, keys, order_by, keep, rank_by)
    )
    return df.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")


def drop_duplicates(df, keys, order_by, keep="first", rank_by=None):
    """One row per key: the first, the last, or the one with the highest rank column.

    ``keep="highest"`` ranks by ``rank_by`` or else the first numeric non-key
    column; null ranks lose, ties go to the first row, and without any numeric
    column it behaves like ``"first"``.
    """
    keys, order_by = _names(keys), _names(order_by)
    _check(df, keys, order_by, keep)
    require_some(order_by, "Name the columns that order the rows (order_by).")
    return _kept(df, keys, order_by, keep, rank_by)


def merge_duplicates(df, keys, order_by, keep="first", rank_by=None, *, removed="removed", sums=()):
    """The rows that ``drop_duplicates`` keeps, each with the number of rows ``removed`` in its favour.

    ``sums`` are number columns that the row kept takes over from the rows removed. One aggregation, combined
    before the shuffle: a task sends one row per key. Returns None where ``highest`` would have to
    rank values that are no numbers, which takes a window.
    """
    keys, order_by = _names(keys), _names(order_by)
    _check(df, keys, order_by, keep)
    require_some(order_by, "Name the columns that order the rows (order_by).")
    require_free(df, [removed])
    place = [col(c) for c in order_by]
    if keep == "highest":
        rank = rank_by or pick_rank_column(df, keys, [*order_by, *sums])
        if rank is not None:
            require_columns(df, [rank], "Rank column")
            if not is_numeric(dtype_of(df, rank)):
                return None
            value = value_of(df, rank)
            # Lowest first, so turned around: the complement of a whole number cannot overflow.
            turned = F.bitwise_not(value) if isinstance(dtype_of(df, rank), INTEGRAL) else -value
            place = [value.isNull(), turned, *place]
    pick = F.max_by if keep == "last" else F.min_by
    rows = [c for c in df.columns if c not in sums]
    merged = df.groupBy(*[k.alias(f"__key_{i}") for i, k in enumerate(_keys(df, keys))]).agg(
        pick(F.struct(*map(col, rows)), F.struct(*place)).alias("__row"),
        *[F.sum(col(c)).alias(c) for c in sums],
        (F.count(F.lit(1)) - 1).alias(removed),
    )
    return merged.select(*[F.col("__row").getField(c).alias(c) for c in rows], *map(col, sums), col(removed))


def mark_duplicates(df, keys, order_by, keep="first", rank_by=None, mask="is_duplicate"):
    """Add a boolean column that is true for every row the keep strategy would drop.

    The kept rows are found from the key, order and rank columns alone; the wide
    rows are shuffled once, on key plus row order, so a hot key is spread evenly.
    """
    keys, order_by = _names(keys), _names(order_by)
    require_free(df, [mask])
    kept = _kept_places(df, keys, order_by, keep, rank_by).withColumn("__is_kept", F.lit(True))
    same = all_of(
        [k.eqNullSafe(F.col(f"__kept_{i}")) for i, k in enumerate(_keys(df, keys))]
        + [col(c).eqNullSafe(F.col(f"__kept_at_{i}")) for i, c in enumerate(order_by)]
    )
    return df.join(kept, same, "left").select(
        *map(col, df.columns), F.col("__is_kept").isNull().alias(mask)
    )


def mark_duplicates_once(df, keys, order_by, keep="first", rank_by=None, mask="is_duplicate", *, min_hot_rows=None):
    """``mark_duplicates`` with one shuffle of rows.

    A first job counts rows by hash of the key. Keys of an ordinary number of rows are numbered in a window. Rows
    of a key with more than ``min_hot_rows`` stay where they are: the row kept of each such key is found
    first, a row per key and task, and looked up.
    """
    keys, order_by = _names(keys), _names(order_by)
    _check(df, keys, order_by, keep)
    require_some(order_by, "Name the columns that order the rows (order_by).")
    require_free(df, [mask])
    names = [f"__key_{i}" for i in range(len(keys))]
    order = _keep_order(df, keys, order_by, keep, rank_by)
    keyed = df.withColumns(dict(zip(names, _keys(df, keys))))
    first = Window.partitionBy(*names).orderBy(*order)

    def numbered(rows):
        return rows.select(*map(col, df.columns), (F.row_number().over(first) > 1).alias(mask))

    hot = hot_keys(keyed, None, names, min_hot_rows=min_hot_rows)
    if hot is None:
        return numbered(keyed)
    places = [f"__at_{i}" for i in range(len(order_by))]
    hot_rows = hot.rows_of(keyed).withColumns({p: col(c) for p, c in zip(places, order_by)})
    kept = hot_rows.withColumn("__place", F.row_number().over(first)).where("__place = 1")
    kept = kept.select(*[F.col(n).alias(f"__kept_{i}") for i, n in enumerate(names)], *[F.col(p).alias(f"{p}_kept") for p in places])
    same = all_of(F.col(n).eqNullSafe(F.col(f"__kept_{i}")) for i, n in enumerate(names))
    # One row per hot key, of which there are at most rows / min_hot_rows.
    found = hot_rows.join(F.broadcast(kept), same)
    stays = all_of(F.col(p).eqNullSafe(F.col(f"{p}_kept")) for p in places)
    return numbered(hot.rows_of(keyed, "left_anti")).unionAll(found.select(*map(col, df.columns), (~stays).alias(mask)))


def _kept_places(df, keys, order_by, keep, rank_by):
    """``__kept_<i>, __kept_at_<i>``: keys and order columns of the rows that stay, one per key."""
    _check(df, keys, order_by, keep)
    require_some(order_by, "Name the columns that order the rows (order_by).")
    if keep in ("first", "last") and len(order_by) == 1:
        pick = F.min if keep == "first" else F.max
        return df.groupBy(*[k.alias(f"__kept_{i}") for i, k in enumerate(_keys(df, keys))]).agg(
            pick(col(order_by[0])).alias("__kept_at_0")
        )
    return _kept(df, keys, order_by, keep, rank_by).select(
        *[k.alias(f"__kept_{i}") for i, k in enumerate(_keys(df, keys))],
        *[col(c).alias(f"__kept_at_{i}") for i, c in enumerate(order_by)],
    )


def duplicate_mask(df, keys, order_by, keep="first", rank_by=None, mask="is_duplicate"):
    """The mask alone: the order columns, which must identify a row in the whole table, and its flag.

    Only key, order and rank columns are read and shuffled; no row is joined.
    """
    keys, order_by = _names(keys), _names(order_by)
    _check(df, keys, order_by, keep)
    require_some(order_by, "Name the columns that order the rows (order_by).")
    require_free(df.select(*map(col, order_by)), [mask])
    places = _kept_places(df, keys, order_by, keep, rank_by)
    kept = places.select(*[F.col(f"__kept_at_{i}").alias(c) for i, c in enumerate(order_by)], F.lit(False).alias("__m"))
    rows = df.select(*map(col, order_by), F.lit(True).alias("__m"))
    # A row identified by its order columns is flagged unless it is among those that stay.
    return rows.unionAll(kept).groupBy(*map(col, order_by)).agg(F.min("__m").alias(mask))


def duplicate_rows(df, keys, order_by, keep="first", rank_by=None):
    """Only the flagged rows."""
    flagged = mark_duplicates(df, keys, order_by, keep, rank_by, mask="__flag")
    return flagged.where("__flag").drop("__flag")


def count_duplicates(df, keys, by=()):
    """``total_rows, duplicate_rows`` overall or per ``by`` column; no row is moved."""
    grouped = df.groupBy(
        *[col(b).alias(b) for b in by],
        *[k.alias(f"__k{i}") for i, k in enumerate(_keys(df, keys))],
    ).agg(F.count(F.lit(1)).alias("__n"))
    return grouped.groupBy(*map(col, by)).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_report(df, keys, keep="first"):
    """One row: columns checked, row and duplicate counts, share in %, strategy."""
    keys = _names(keys)
    _check(df, keys, [], keep)
    return count_duplicates(df, keys).select(
        F.lit(", ".join(keys)).alias("columns_checked"),
        "total_rows",
        "duplicate_rows",
        rounded_percent(F.col("duplicate_rows"), F.col("total_rows"), 1).alias("duplicate_pct"),
        F.lit(keep).alias("keep_strategy"),
    )


def full_row_duplicates(df):
    """One row: how many rows repeat an earlier row in every column."""
    return count_duplicates(df, df.columns)
