"""What is known of each file of a folder, kept as a table that grows with the files.

A batch of states is written to ``path/data`` first and listed in ``path/manifest`` last, so that an update which breaks
off is never read. The latest batch of a file counts; a file that is gone has one row that says so. A table of
states has one writer at a time.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table
from tallyframe.sources.files import list_files

MANIFEST_SCHEMA = "batch string, number long"
FILE_SCHEMA = "file string, size_bytes long, modified_us long"
FILE_COLUMNS = ["file", "size_bytes", "modified_us"]


def _listed(spark, path, schema):
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], schema)


def _manifest(spark, path):
    return _listed(spark, f"{path}/manifest", MANIFEST_SCHEMA)


def read_states(spark, path, schema):
    """The latest rows of every file that is still there: ``FILE_SCHEMA`` and the columns of ``schema``."""
    rows = _listed(spark, f"{path}/data", f"{FILE_SCHEMA}, {schema}, gone boolean, batch string")
    rows = rows.join(_manifest(spark, path), "batch")
    latest = rows.groupBy("file").agg(F.max("number").alias("number"))
    return rows.join(latest, ["file", "number"], "left_semi").where("NOT gone").drop("gone", "batch", "number")


def changed_files(spark, states, folder):
    """``(fresh, gone)``: the files directly in ``folder`` that are new or have another length or time, and those
    of ``states`` that are no longer there. Empty files count as no file. The driver sees the fresh ones, as it has to
    name them to a reader."""
    listed = list_files(spark, folder).where("size_bytes > 0")
    listed = listed.select(F.col("path").alias("file"), "size_bytes", F.unix_micros("modified").alias("modified_us"))
    known = states.select(*FILE_COLUMNS).distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in FILE_COLUMNS]
    fresh = listed.alias("l").join(known.alias("k"), same, "left_anti").orderBy("file").collect()
    return local_table(spark, fresh, FILE_SCHEMA), known.join(listed, "file", "left_anti")


def add_states(spark, path, rows, gone):
    """Append a batch: ``rows`` with the states' columns (or None) and the files that are gone."""
    marked = gone.withColumn("gone", F.lit(True))
    if rows is not None:
        marked = rows.withColumn("gone", F.lit(False)).unionByName(marked, allowMissingColumns=True)
    batch = uuid.uuid4().hex
    marked.write.option("compression", "zstd").parquet(f"{path}/data/batch={batch}")
    number = _manifest(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    local_table(spark, [(batch, number)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
