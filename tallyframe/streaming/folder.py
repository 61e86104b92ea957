"""A folder of delimited files as a stream: files that arrive are checked and split.

Only row rules apply, since a row must be judged when it arrives; rules about keys are in ``keyed``. Both outputs are
file sinks, which commit each micro-batch exactly once through their checkpoints.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import col
from tallyframe.operators.rules import UNIQUE, split_rows
from tallyframe.sources.delimited import NA_TOKENS, apply_types


def read_folder_stream(spark, folder, types, sep=",", files_per_batch=1000, corrupt_column="_corrupt_record"):
    """New files of ``folder`` as typed rows; ``types`` gives column names and types.

    A line with more or fewer fields than ``types`` is kept as text in ``corrupt_column``, so that no
    cell of it is lost.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*types, corrupt_column]])
    texts = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", True)
        .option("maxColumns", max(20_480, len(types) + 16))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt_column)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    filled = texts.select(
        *[F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in types],
        col(corrupt_column),
        F.col("_metadata.file_path").alias("_source_file"),
    )
    return apply_types(filled, types)


def split_stream(stream, rules):
    """``(good, bad)`` streams by row rules."""
    kept_out = [r.rule_type for r in rules if r.rule_type == UNIQUE]
    if kept_out:
        raise ValueError("The unique rule needs more than one row: see tallyframe.streaming.keyed.split_unique.")
    return split_rows(stream, rules)


def write_stream(stream, path, checkpoint):
    """Start a query that appends the stream to a parquet table and stops when caught up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
