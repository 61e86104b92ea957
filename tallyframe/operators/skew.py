"""Null-safe equi-joins that stay balanced when a few keys hold most of the rows.

Before the join, one small job counts the rows of both sides in ``BUCKETS`` key hashes. Only if a bucket
holds more than ``MIN_HOT_ROWS`` rows does a second job count the keys in such buckets. A key is hot when
a side has more rows of it than that, however large the table: it is what one task should get. There are
at most rows / ``MIN_HOT_ROWS`` hot keys, and this list is all that reaches the driver. Without hot keys
the join is Spark's plain join, free to broadcast or to use a bucketed layout.

Hot keys are joined apart. A side with many rows of a key is cut into pieces of a bounded number of rows,
and the other side's rows of the key meet every piece, so the work is spread over all tasks; nothing is
broadcast but the list of keys. Rows are dealt to pieces by their running number in the scan, so that
equal rows are spread as well; a re-run of the same files numbers them alike. Inputs whose rows can come
in another order when computed again should be written or checkpointed first.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import all_of, col
from tallyframe.functions.local import local_table

BUCKETS = 4096
MIN_HOT_ROWS = 500_000

LEFT_TAG, RIGHT_TAG = "__in_left", "__in_right"


class HotKeys:
    """Hot keys with their row counts, and the counts above which a key is hot."""

    def __init__(self, left, keys, schema, rows, limits):
        self.spark, self.keys, self.schema = left.sparkSession, keys, schema
        self.rows, self.limits = rows, limits

    def table(self, rows):
        """``keys, __cuts_left, __cuts_right`` for some of the rows, small enough to broadcast."""
        width = len(self.keys)
        cut = [
            (*row[:width], *(max(1, -int(-n // self.limits[s])) for s, n in zip("lr", row[width:])))
            for row in rows
        ]
        schema = T.StructType(self.schema.fields[:width])
        schema = schema.add("__cuts_left", T.IntegerType()).add("__cuts_right", T.IntegerType())
        listed = local_table(self.spark, cut, schema)
        # Instants were counted as numbers, so that no time zone of the driver touches them.
        instants = {
            k: F.timestamp_micros(col(k)) for k, f in zip(self.keys, self.schema) if f.metadata.get("instant")
        }
        return F.broadcast(listed.withColumns(instants) if instants else listed)

    def rows_of(self, df, how="left_semi"):
        """The rows of ``df`` whose key is hot, or with ``left_anti`` is not."""
        return _with_keys(df, self.table(self.rows), self.keys, how)

    def kinds(self):
        """``(keys with rows on both sides, keys of one side only)``."""
        both = [row for row in self.rows if min(row[-2:]) > 0]
        return both, [row for row in self.rows if min(row[-2:]) == 0]


def hot_keys(left, right, keys, *, min_hot_rows=None, buckets=None):
    """The ``HotKeys`` of two sides, or None if there are none.

    ``right`` may be None where its rows need no counting. Nested keys are left to
    Spark's own skew handling.
    """
    min_hot_rows = MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows
    buckets = buckets or BUCKETS
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    if any(isinstance(left.schema[k].dataType, nested) for k in keys):
        return None
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    key_columns = [col(k) for k in keys]
    rows = left.select(*key_columns, one.alias("l"), none.alias("r"))
    if right is not None:
        rows = rows.unionAll(right.select(*key_columns, none.alias("l"), one.alias("r")))
    bucket = F.pmod(F.xxhash64(*key_columns), F.lit(buckets)).cast("int")
    sums = [F.sum("l").alias("l"), F.sum("r").alias("r")]

    histogram = rows.groupBy(bucket.alias("bucket")).agg(*sums).collect()
    limits = {side: min_hot_rows for side in "lr"}
    overfull = [row.bucket for row in histogram if any(row[s] > limits[s] for s in "lr")]
    if not overfull:
        return None

    def plain(field):
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(col(field.name)).alias(field.name, metadata={"instant": True})
        return col(field.name)

    counted = (
        rows.where(bucket.isin(overfull))
        .groupBy(*key_columns)
        .agg(*sums)
        .where((F.col("l") > limits["l"]) | (F.col("r") > limits["r"]))
    )
    counted = counted.select(*[plain(f) for f in counted.schema[: len(keys)]], "l", "r")
    found = [tuple(row) for row in counted.collect()]
    return HotKeys(left, keys, counted.schema, found, limits) if found else None


def _with_keys(df, listed, keys, how):
    """Rows of ``df`` whose key is listed (``left_semi``, ``inner``) or is not (``left_anti``)."""
    listed = listed.withColumnsRenamed({k: f"__hot_{i}" for i, k in enumerate(keys)})
    same = all_of(col(k).eqNullSafe(F.col(f"__hot_{i}")) for i, k in enumerate(keys))
    return df.join(listed, same, how).drop(*[f"__hot_{i}" for i in range(len(keys))])


def _cut(df, listed, keys, own, other):
    """Rows of hot keys with ``__piece_<own>`` by running number, once per ``__piece_<other>``."""
    every = F.explode(F.sequence(F.lit(0), F.col(f"__cuts_{other}") - 1))
    cut = _with_keys(df.withColumn("__number", F.monotonically_increasing_id()), listed, keys, "inner")
    cut = cut.withColumn(f"__piece_{own}", F.pmod("__number", F.col(f"__cuts_{own}")).cast("int"))
    return cut.withColumn(f"__piece_{other}", every).drop("__cuts_left", "__cuts_right", "__number")


def _join(left, right, keys, how, pieces=()):
    """The plain join; keys come from whichever side has them, flags say which do."""
    left_names = [c for c in left.columns if c not in (*keys, *pieces)]
    right_names = [c for c in right.columns if c not in (*keys, *pieces)]
    lhs = left.withColumn(LEFT_TAG, F.lit(True))
    rhs = right.select(
        *[col(k).alias(f"__right_{i}") for i, k in enumerate([*keys, *pieces])],
        *map(col, right_names),
        F.lit(True).alias(RIGHT_TAG),
    )
    same = all_of(
        col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate([*keys, *pieces])
    )
    joined = lhs.join(rhs, same, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*map(col, keys), *map(col, left_names))
    return joined.select(
        *[
            F.when(F.col(LEFT_TAG), col(k)).otherwise(F.col(f"__right_{i}")).alias(k)
            for i, k in enumerate(keys)
        ],
        *map(col, left_names),
        *map(col, right_names),
        LEFT_TAG,
        RIGHT_TAG,
    )


def skew_join(
    left, right, keys, how, *, right_unique=False, left_unique=False, min_hot_rows=None, buckets=None
):
    """Join on ``left.k <=> right.k`` for every key, in any of Spark's join modes.

    Both sides must carry the key columns under the same names and no other name
    in common. The result holds the keys, the left columns, the right columns and
    the flags ``__in_left`` / ``__in_right`` (null when that side has no row).
    ``right_unique`` promises at most one right row per key, whose rows then need
    no counting; with ``left_unique`` as well no key can be hot.
    """
    if how in ("left_semi", "left_anti") and not right_unique:
        right, right_unique = right.select(*map(col, keys)).distinct(), True
    hot = counted = None
    if not (left_unique and right_unique):
        left_decides = right_unique and how in ("inner", "left", "left_semi", "left_anti")
        counted = None if left_decides else right
        hot = hot_keys(left, counted, keys, min_hot_rows=min_hot_rows, buckets=buckets)
    if hot is None:
        return _join(left, right, keys, how)

    def rows_of(df, listed, how="left_semi"):
        return _with_keys(df, hot.table(listed), keys, how)

    cold = [rows_of(df, hot.rows, "left_anti") for df in (left, right)]
    parts = [_join(*cold, keys, how)]
    pieces = ["__piece_left", "__piece_right"]

    def cut_join(listed, how):
        listed = hot.table(listed)
        sides = _cut(left, listed, keys, "left", "right"), _cut(right, listed, keys, "right", "left")
        return _join(*sides, keys, how, pieces)

    if counted is None:
        # The right side's one row of a key meets every piece, so any of these modes holds piece by piece.
        parts.append(cut_join(hot.rows, how))
    else:
        both, alone = hot.kinds()
        if both:
            # Every key here has rows on both sides, so all modes come to an inner join.
            parts.append(cut_join(both, "inner"))
        if alone:
            # Nothing to meet: Spark plans this without a shuffle.
            parts.append(_join(rows_of(left, alone), right.where(F.lit(False)), keys, how))
            parts.append(_join(left.where(F.lit(False)), rows_of(right, alone), keys, how))
    return reduce(lambda a, b: a.unionAll(b), parts)


def mark_counted(df, counted, keys, flag, limit=None):
    """Add ``flag``: the row's key is in ``counted`` (the keys, each once, and ``__n``, its rows in ``df``).

    ``df`` appears once in the plan and nothing runs while it is made. The rows of a key with more than
    ``limit`` are dealt to pieces by their running number, and the key's one counted row meets each. What
    is broadcast are hashes of such keys: at most rows / ``limit`` of 16 bytes.
    """
    limit = limit or MIN_HOT_ROWS
    number = F.xxhash64(*map(col, keys))
    cuts = counted.select(number.alias("__hash"), F.ceil(F.col("__n") / limit).cast("int").alias("__cuts"))
    hot = cuts.where("__cuts > 1").groupBy("__hash").agg(F.max("__cuts").alias("__cuts"))
    hot = F.broadcast(hot)
    cuts = F.coalesce("__cuts", F.lit(1))
    rows = df.withColumns({"__number": F.monotonically_increasing_id(), "__key": number})
    rows = rows.join(hot, F.col("__key") == F.col("__hash"), "left").withColumn("__piece", F.pmod("__number", cuts).cast("int"))
    rows = rows.drop("__number", "__key", "__hash", "__cuts")
    met = counted.select(*map(col, keys), number.alias("__key")).join(hot, F.col("__key") == F.col("__hash"), "left")
    met = met.select(*map(col, keys), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("__piece"))
    joined = _join(rows, met, keys, "left", ["__piece"])
    return joined.withColumn(flag, F.coalesce(F.col(RIGHT_TAG), F.lit(False))).drop(LEFT_TAG, RIGHT_TAG)
