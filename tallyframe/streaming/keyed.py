"""Keyed state over arriving rows: keep-first and ``unique`` where a key's rows come in different files.

A stream never ends, so "all rows of a key" is a session: rows of one key of which none follows the one before by
more than ``gap``. A session is given out once, when the watermark (the latest time seen less ``delay``) has passed its
last time plus ``gap``; until then it is one row of state, the first row and a count, however many rows it has. State
is combined within tasks before the shuffle, so a key with a third of all rows sends one row per task and session
(with ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``, which ``build_session`` sets).

Over a table that does not stream, the same functions give all sessions, the open ones included.
"""

from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import col, dtype_of, known

COUNT = "session_rows"


def first_per_session(rows, keys, at, order_by=(), gap="1 hour", delay="1 hour"):
    """The first row of every key and session, with ``session_rows``, how many rows the session has.

    First is the least ``at``, then the least ``order_by``. Null and NaN are one key. Rows without a time are in no
    session: ``rows_without_time`` gives them. Rows that arrive behind the watermark are left out by Spark and
    counted by ``rows_too_late``; choose ``delay`` so that there are none.
    """
    require_some(keys, "Name the key columns.")
    require_columns(rows, [*keys, at, *order_by])
    if COUNT in rows.columns:
        raise ValueError(f"The rows already have a column {COUNT!r}.")
    groups = [known(F.col("row").getField(k), dtype_of(rows, k)).alias(f"key{i}") for i, k in enumerate(keys)]
    timed = rows.select(F.struct(*map(col, rows.columns)).alias("row"), col(at).cast("timestamp").alias("moment"))
    place = F.struct("moment", *[F.col("row").getField(c) for c in order_by])
    sessions = timed.withWatermark("moment", delay).groupBy(F.session_window("moment", gap).alias("session"), *groups)
    found = sessions.agg(F.min_by("row", place).alias("row"), F.count(F.lit(1)).alias(COUNT))
    return found.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], COUNT)


def split_unique(rows, keys, at, order_by=(), gap="1 hour", delay="1 hour"):
    """``(good, repeated)``: rows whose key occurs once in its session, and the first row of each other session.

    ``repeated`` has ``session_rows``; the rows behind that count are those of the input with its key and session.
    """
    first = first_per_session(rows, keys, at, order_by, gap, delay)
    return first.where(F.col(COUNT) == 1).drop(COUNT), first.where(F.col(COUNT) > 1)


def rows_without_time(rows, at):
    require_columns(rows, [at])
    return rows.where(col(at).isNull())


def rows_too_late(query):
    """How many rows a streaming query left out, by its recent progress, as they came behind the watermark."""
    return sum(
        state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"]
    )
