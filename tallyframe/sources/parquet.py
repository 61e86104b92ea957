"""Parquet tables with the stored place of every row."""

from pyspark.sql import functions as F

from tallyframe.sources.files import BLOCK, POSITION, SOURCE


def read_parquet(spark, paths, positions=False):
    """A parquet table of one or several files.

    ``positions`` adds ``POSITION_COLUMNS``: the file, 0 for its one block, and the row's number in the
    file. A number alone would not identify a row, since every file counts from 0.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    if not positions:
        return df
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(SOURCE),
        F.lit(0).cast("long").alias(BLOCK),
        F.col("_metadata.row_index").alias(POSITION),
    )
