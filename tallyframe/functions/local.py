"""Small driver-side lists as DataFrames Spark knows the size of."""

import pyarrow as pa
from pyspark.sql import types as T


def local_table(spark, rows, schema):
    """A literal table of ``rows`` (tuples); unlike one made from a Python list
    through an RDD, the optimizer sees how small it is."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(values)) for values in columns]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, [f.name for f in schema]), schema)
