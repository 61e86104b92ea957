"""File listings, suffix checks and row positions shared by the readers."""

import re
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.errors import UnsupportedFileTypeError
from tallyframe.functions.columns import col
from tallyframe.functions.local import local_table
from tallyframe.session import shared_folder

# Readable suffixes and the field separator of the delimited ones.
SEPARATORS = {".csv": ",", ".tsv": "\t"}
WORKBOOK_SUFFIXES = (".xlsx", ".xlsm")
PARQUET_SUFFIXES = (".parquet",)

SOURCE, BLOCK, POSITION = "_source_file", "_block_start", "_position"


def suffix_of(path):
    match = re.search(r"\.[^./\\]+$", path.rstrip("/"))
    return match[0].lower() if match else ""


def require_suffix(path, suffixes):
    if suffix_of(path) not in suffixes:
        raise UnsupportedFileTypeError(
            f"Unsupported file type: {suffix_of(path)!r}; expected one of {sorted(suffixes)}"
        )


def list_files(spark, folder):
    """``path, size_bytes, modified`` per file directly in ``folder``; no content is read.

    Paths are URIs as in ``_metadata.file_path``. Empty files are listed too,
    without a time, although Spark's scans leave them out.
    """
    listed = spark.read.format("binaryFile").load(folder)
    uris = [re.sub(r"^file:/+", "file:/", name) for name in listed.inputFiles()]
    names = local_table(spark, [(uri,) for uri in uris], "path string")
    found = listed.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )
    return names.join(found, "path", "left").select(
        "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "modified"
    )


def readable_path(uri):
    """A listed URI in the form Spark's readers take."""
    return unquote(uri)


def open_file(uri):
    """A readable, seekable file for a listed URI; meant for use inside tasks."""
    from pyarrow import fs

    system, location = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(location)


def with_position(scan):
    """Add the row's place right after a file scan: file, block offset, running number.

    The three columns together identify a row and order the rows of a file as
    they were written, however the blocks are spread over tasks.
    """
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POSITION),
    )


def write_once(df, purpose):
    """``df`` written below the shared folder and read back, so that later jobs do not compute it again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


POSITION_COLUMNS = [SOURCE, BLOCK, POSITION]


def number_rows(positioned, name="row_no", across_files=False):
    """Replace block and running number by a gapless row number from 0 per file, or over all files by path.

    One count per file block is summed up in file order; no row is sorted or
    moved, as the block sums are small enough for Spark to broadcast on its own. Over
    all files, the driver adds up one count per file while the plan is made.
    """
    blocks = positioned.groupBy(SOURCE, BLOCK).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(POSITION).alias("__first")
    )
    earlier = (
        Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        F.col(SOURCE).alias("__file"),
        F.col(BLOCK).alias("__block"),
        "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
    )
    if across_files:
        counts = blocks.groupBy(SOURCE).agg(F.sum("__rows")).orderBy(SOURCE).collect()
        starts = accumulate((n for _, n in counts), initial=0)
        listed = [(path, start) for (path, _), start in zip(counts, starts)]
        files = local_table(positioned.sparkSession, listed, "__path string, __start long")
        offsets = offsets.join(files, F.col("__file") == F.col("__path")).select(
            "__file", "__block", "__first", (F.col("__before") + F.col("__start")).alias("__before")
        )
    same = (F.col(SOURCE) == F.col("__file")) & (F.col(BLOCK) == F.col("__block"))
    number = F.col("__before") + F.col(POSITION) - F.col("__first")
    kept = [c for c in positioned.columns if c not in (BLOCK, POSITION)]
    return positioned.join(offsets, same).select(*map(col, kept), number.alias(name))
