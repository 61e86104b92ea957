"""Profiles that grow with their files: what is known of each file is kept, and only new files are read.

A file's state holds, per column, exact counts, lengths and ranges, a HyperLogLog sketch of its texts, a KLL sketch
of its numbers and its first distinct texts. States are merged without touching the files again. Row figures of
the merged profile are exact; distinct counts are estimates with a standard error of ``DISTINCT_ERROR``, a share
of the count, and quantiles are off by some hundredth of the rows.
"""

from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import col, dtype_of, is_numeric
from tallyframe.operators.profile import EXAMPLE_COUNT, cells_of, first_examples, of_column, with_shares
from tallyframe.sources.file_states import FILE_COLUMNS, add_states, changed_files, read_states
from tallyframe.sources.files import BLOCK, POSITION, POSITION_COLUMNS, SOURCE, readable_path
from tallyframe.sources.parquet import read_parquet

PRECISION = 14  # a sketch has 2 ** PRECISION registers and takes 16 KB at most
DISTINCT_ERROR = 1.04 / 2 ** (PRECISION / 2)

STATE_SCHEMA = (
    "ordinal int, column string, dtype string, is_numeric boolean,"
    " rows long, null_count long, min_length int, max_length int, min_value double, max_value double,"
    " distinct binary, numbers binary, first array<struct<place: struct<block: long, position: long>, value: string>>"
)


def read_positions(spark, paths):
    return read_parquet(spark, paths, positions=True)


def update_profile(spark, path, folder, columns=None, read=read_positions):
    """Bring the states at ``path`` up to date with the files directly in ``folder``.

    Files of another length or time than when they were read are read again; files that are gone leave the
    profile; empty files count as no file. ``read(spark, paths)`` returns rows with ``POSITION_COLUMNS``. Columns
    and types must stay the same from update to update, or the call fails before it writes. Returns the number of
    files read; the driver sees the paths of those.
    """
    states = file_states(spark, path)
    fresh, gone = changed_files(spark, states, folder)
    paths = [row.file for row in fresh.collect()]
    if not paths and gone.isEmpty():
        return 0
    rows = None
    if paths:
        df = read(spark, [readable_path(p) for p in paths])
        chosen = list(columns or [c for c in df.columns if c not in POSITION_COLUMNS])
        require_some(chosen, "The table has no columns.")
        require_columns(df, [*chosen, *POSITION_COLUMNS])
        _require_same_types(states, df, chosen)
        rows = _states(df, fresh, chosen)
    add_states(spark, path, rows, gone)
    return len(paths)


def _require_same_types(states, df, columns):
    stored = {r.ordinal: (r.column, r.dtype) for r in states.select("ordinal", "column", "dtype").distinct().collect()}
    found = {i: (c, dtype_of(df, c).simpleString()) for i, c in enumerate(columns)}
    if stored and stored != found:
        other = [f"{c} {t}" for c, t in set(stored.values()) ^ set(found.values())]
        raise ValueError(f"The files have other columns or types than those profiled before: {sorted(other)}")


def _states(df, files, columns):
    """One row per file and column; files without rows have counts of 0."""
    numeric = [is_numeric(dtype_of(df, c)) for c in columns]
    number = F.when(of_column(columns, numeric), F.col("value").try_cast("double"))
    figures = cells_of(df, columns, [col(SOURCE).alias("file")]).groupBy("file", "ordinal").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.hll_sketch_agg("value", PRECISION).alias("distinct"),
        F.kll_sketch_agg_double(number).alias("numbers"),
    )
    place = F.struct(col(BLOCK).alias("block"), col(POSITION).alias("position")).alias("place")
    texts = cells_of(df, columns, [col(SOURCE).alias("file"), place]).where("value IS NOT NULL")
    texts = texts.groupBy("file", "ordinal", "value").agg(F.min("place").alias("place"))
    first = first_examples(texts, EXAMPLE_COUNT, ["file", "ordinal"]).groupBy("file", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("first")
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                F.lit(dtype_of(df, c).simpleString()).alias("dtype"), F.lit(n).alias("is_numeric"),
            )
            for i, (c, n) in enumerate(zip(columns, numeric))
        ]
    )
    rows = files.select(*FILE_COLUMNS, F.inline(described))
    rows = rows.join(figures, ["file", "ordinal"], "left").join(first, ["file", "ordinal"], "left")
    return rows.fillna(0, ["rows", "null_count"])


def file_states(spark, path):
    """The latest state of every file that is still there: a row per file and column."""
    return read_states(spark, path, STATE_SCHEMA)


def merged_profile(states):
    """``profile_columns`` of all files together, its distinct counts estimated."""
    figures = states.groupBy("ordinal", "column", "dtype", "is_numeric").agg(
        F.sum("rows").alias("rows"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_count"),
        F.min("min_length").alias("min_length"),
        F.max("max_length").alias("max_length"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
    )
    filled = F.col("rows") - F.col("null_count")
    return with_shares(figures.withColumn("unique_count", F.least("unique_count", filled)))


def merged_examples(states, count=EXAMPLE_COUNT):
    """Per column the first distinct texts, ``EXAMPLE_COUNT`` at most, files in order of their paths."""
    if count > EXAMPLE_COUNT:
        raise ValueError(f"States keep {EXAMPLE_COUNT} examples of a column.")
    texts = states.select("file", "ordinal", "column", F.explode("first").alias("cell")).groupBy(
        "ordinal", "column", F.col("cell.value").alias("value")
    ).agg(F.min(F.struct("file", "cell.place")).alias("place"))
    kept = first_examples(texts, count, ["ordinal", "column"]).groupBy("ordinal", "column").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells")
    )
    columns = states.select("ordinal", "column").distinct()
    return columns.join(kept, ["ordinal", "column"], "left").select(
        "ordinal", "column", F.coalesce("cells.value", F.array().cast("array<string>")).alias("examples")
    )


def merged_quantiles(states, shares=(0.25, 0.5, 0.75)):
    """``ordinal, column, quantiles``: per numeric column its values at ``shares``; null where it has no number."""
    merged = states.where("is_numeric").groupBy("ordinal", "column").agg(
        F.kll_merge_agg_double("numbers").alias("numbers")
    )
    values = F.array(*[F.kll_sketch_get_quantile_double("numbers", F.lit(float(s))) for s in shares])
    return merged.select(
        "ordinal", "column", F.when(F.kll_sketch_get_n_double("numbers") > 0, values).alias("quantiles")
    )
