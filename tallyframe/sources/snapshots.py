"""Versioned snapshots of many tables, and their restore.

Each snapshot goes to a new version folder; its manifest is written last, so a
snapshot that broke off is never seen and the previous one stays valid.
"""

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table

ENTRY_SCHEMA = (
    "version string, file_key string, sheet_name string, display_name string, "
    "location string, saved_at string, error string"
)


def snapshot_tables(tables, folder, saved_at):
    """Write ``[(file_key, sheet_name, display_name, df), ...]`` as one new version.

    ``saved_at`` is a datetime and orders the versions. A table that cannot be
    written is recorded with its error and loses none of the others.
    """
    folder = folder.rstrip("/")
    version = saved_at.strftime("%Y%m%dT%H%M%S%f")
    entries, spark = [], None
    for number, (file_key, sheet, display, df) in enumerate(tables):
        spark = df.sparkSession
        location, error = f"{folder}/data/{version}/{number}", None
        try:
            df.write.mode("errorifexists").parquet(location)
        except PySparkException as failure:
            error = str(failure).splitlines()[0]
        stamp = saved_at.isoformat(timespec="seconds")
        entries.append((version, file_key, sheet, display, location, stamp, error))
    manifest = local_table(spark, entries, ENTRY_SCHEMA).coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifests/{version}")
    return version


def load_manifest(spark, folder):
    """The newest snapshot's entries that were written; an empty table if there is none."""
    try:
        manifests = spark.read.option("recursiveFileLookup", True).schema(ENTRY_SCHEMA).parquet(
            f"{folder.rstrip('/')}/manifests"
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], ENTRY_SCHEMA)
    newest = manifests.agg(F.max("version").alias("version")).first().version
    return manifests.where((F.col("version") == newest) & F.col("error").isNull())


def restore_tables(spark, folder):
    """``{(file_key, sheet_name): df}`` of the newest snapshot; unreadable tables are skipped."""
    restored = {}
    for entry in load_manifest(spark, folder).collect():
        try:
            restored[entry.file_key, entry.sheet_name] = spark.read.parquet(entry.location)
        except PySparkException:
            continue
    return restored
