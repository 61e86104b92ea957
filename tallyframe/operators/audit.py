"""The audit log as an append-only table: write, search, count, prune."""

import uuid
from datetime import timedelta
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe.errors import require_columns
from tallyframe.functions.local import local_table
from tallyframe.operators.search import search_rows
from tallyframe.sources.files import write_once

ENTRY_SCHEMA = "id long, timestamp string, file_key string, sheet_name string, operation string"
SEARCHED = ("file_key", "sheet_name", "operation")


def append_entries(spark, path, entries, at):
    """Append ``[(file_key, sheet_name, operation), ...]`` made at the datetime ``at``.

    Files are laid out by day, which is what pruning drops. Ids continue from the
    highest one so far; a log has one writer at a time.
    """
    last = 0
    try:
        last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    stamp = at.isoformat(timespec="seconds")
    rows = [(last + n, stamp, *entry) for n, entry in enumerate(entries, start=1)]
    day = F.substring("timestamp", 1, 10)
    local_table(spark, rows, ENTRY_SCHEMA).withColumn("day", day).coalesce(1).write.mode(
        "append"
    ).partitionBy("day").parquet(path)


def append_log(spark, path, entries, at, order_by):
    """Append a DataFrame ``entries`` (file_key, sheet_name, operation, ...) of any size, made at the datetime ``at``.

    Ids follow ``order_by`` and continue from the highest one so far, without gaps: rows are sorted and written to
    scratch, counted per task, and numbered from there; the driver adds up one count per task. The batch goes to
    ``path/data``, laid out by day, and is listed in ``path/manifest`` last: an append that breaks off before
    is never read, see ``read_log``. A log has one writer at a time. Returns the number of entries appended.
    """
    require_columns(entries, ["file_key", "sheet_name", "operation", *order_by])
    last = _manifest(spark, path).agg(F.coalesce(F.max("last_id"), F.lit(0)).cast("long")).first()[0]
    rows = entries.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # The lower 33 bits of a running number count a task's rows.
    place = {"__task": F.shiftright(F.monotonically_increasing_id(), 33), "__row": F.monotonically_increasing_id() % (1 << 33)}
    rows = write_once(rows.select("file_key", "sheet_name", "operation").withColumns(place), "audit")
    counts = rows.groupBy("__task").agg(F.count(F.lit(1))).orderBy("__task").collect()
    if not counts:
        return 0
    starts = accumulate((n for _, n in counts), initial=last + 1)
    offsets = local_table(spark, [(task, start) for (task, _), start in zip(counts, starts)], "__t long, __start long")
    batch, stamp = uuid.uuid4().hex, at.isoformat(timespec="seconds")
    numbered = rows.join(offsets, F.col("__task") == F.col("__t")).select(
        (F.col("__start") + F.col("__row")).alias("id"), F.lit(stamp).alias("timestamp"), "file_key", "sheet_name", "operation",
        F.lit(stamp[:10]).alias("day"),
    )
    numbered.write.partitionBy("day").parquet(f"{path}/data/batch={batch}")
    total = sum(n for _, n in counts)
    listed = local_table(spark, [(batch, last + 1, last + total)], MANIFEST_SCHEMA)
    listed.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return total


MANIFEST_SCHEMA = "batch string, first_id long, last_id long"


def _manifest(spark, path):
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], MANIFEST_SCHEMA)


def read_log(spark, path):
    """The entries of every batch that was appended as a whole."""
    batches = _manifest(spark, path).select("batch")
    if batches.isEmpty():
        return local_table(spark, [], ENTRY_SCHEMA)
    names = ["id", "timestamp", "file_key", "sheet_name", "operation"]
    schema = f"{ENTRY_SCHEMA}, batch string, day string"
    return spark.read.schema(schema).parquet(f"{path}/data").join(batches, "batch", "left_semi").select(*names)


def query_entries(entries, search=None, limit=None, columns=SEARCHED, newest="id"):
    """Newest first, all of them unless ``limit`` is given; ``search`` looks into ``columns``, case aside."""
    require_columns(entries, [*columns, newest])
    found = search_rows(entries, search, columns) if search else entries
    ordered = found.orderBy(F.col(newest).desc())
    return ordered if limit is None else ordered.limit(limit)


def count_entries(entries):
    return entries.agg(F.count(F.lit(1)).alias("entries"))


def prune_entries(entries, days, now, timestamp="timestamp"):
    """``(kept, removed)``: entries of the last ``days`` days before ``now``, and the count of others.

    Entries without a timestamp are kept, as nothing says they are old. Of a log laid out by day, only
    the files of days that may be kept are read for the rows, and none for older days.
    """
    # As text, since a datetime literal would be moved to the session's time zone.
    edge = now - timedelta(days=days)
    cutoff = F.lit(edge.isoformat(sep=" ")).cast("timestamp_ntz")
    expired = F.coalesce(F.col(timestamp).cast("timestamp_ntz") < cutoff, F.lit(False))
    removed = entries.agg(F.count_if(expired).alias("removed"))
    kept = entries.where(~expired)
    if "day" in entries.columns:
        day = F.col("day").cast("string")
        kept = kept.where(day.isNull() | (day >= edge.date().isoformat()))
    return kept, removed


def audit_export(entries, limit=None):
    """The export table: entries under their display names, newest first."""
    return query_entries(entries, limit=limit).select(
        F.col("timestamp").alias("Timestamp"),
        F.col("file_key").alias("File"),
        F.col("sheet_name").alias("Sheet"),
        F.col("operation").alias("Operation"),
    )
