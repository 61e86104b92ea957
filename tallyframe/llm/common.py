"""Helpers the corpus operators share."""

import ctypes
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.session import shared_folder

# Characters that separate words: space, and tab to carriage return.
SPACES = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark):
    """Make this package importable in Spark's Python workers, wherever they run; done once a session."""
    context = spark.sparkContext
    if getattr(context, "_tallyframe_shipped", None):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Spark copies the archive to every executor; the driver's own copy lives as long as the session.
    kept = tempfile.TemporaryDirectory(prefix="tallyframe-package-")
    path = os.path.join(kept.name, "tallyframe-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._tallyframe_shipped = kept


def table(spark, folder, name):
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df, purpose):
    """``df`` written once below the shared folder and read back: computed once, without lineage.

    A lost executor costs nothing that was staged, and a retried task reads the same rows.
    """
    ship(df.sparkSession)
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_column, parts):
    """The remainder of a document id's checksum, by which rows are held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def utf8(texts):
    """An Arrow text array as a list of bytes; null gives None."""
    return texts.cast(pa.binary()).to_pylist()


def slices(texts, step_bytes=1 << 20):
    """An Arrow text array in slices of about ``step_bytes``, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes, dtype=np.int64) // step_bytes
    starts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(sizes) else []
    for a, b in zip(starts, np.append(starts[1:], len(sizes))):
        yield texts.slice(a, b - a)


def give_back():
    """Hands memory that a worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def characters(text):
    """Code points of UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def spread(columns, rows, rows_per_bucket):
    """A bucket number that spreads rows by a hash, about ``rows_per_bucket`` each."""
    return F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-rows // rows_per_bucket))))


def running_start(df, groups, bucket, order, amount, name):
    """Adds ``name``: the sum of ``amount`` over the rows before this one in its group.

    A group may hold any share of the rows. Rows are summed within (group, bucket), and only the
    bucket sums, a small fraction of the rows, are added up along a group.
    """
    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(
        sums, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    )
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop(
        "_before", "_within", *[f"_k{i}" for i in range(len(keys))]
    )


def runs(batches):
    """Arrow batches sorted by their first column, a long: (table, starts of runs) pieces of whole runs.

    Runs have to be of bounded length, as the last one is held back until its end is seen.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        keys = part.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        if len(starts) > 1:
            yield part.slice(0, starts[-1]).combine_chunks(), starts
        rest = part.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def forest(left, right, nodes):
    """Roots (smallest member) of ``nodes`` nodes under the links left[i] - right[i], in numpy."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root


# So many links of a component search, 16 bytes each, are a task's work.
LOCAL_LINKS = 1_000_000


def _finish(batches):
    """(node, root) of the links of a bounded table."""
    parts = [np.stack([batch.column(c).to_numpy() for c in "ab"]) for batch in batches]
    if not parts:
        return
    links = np.concatenate(parts, 1)
    names, place = np.unique(links, return_inverse=True)
    left, right = place.reshape(links.shape)
    roots = names[forest(left, right, len(names))]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(roots)], ["node", "root"])


def components(links):
    """(node, root) for every node of ``links`` (a, b): the smallest node reachable.

    Alternates two star operations until nothing changes: every node's larger neighbours, then its
    smaller ones, are linked to its smallest. A node may have any number of links: neighbours are only
    aggregated and joined, and adaptive execution splits the joins. Every round is written down. As soon as
    at most ``LOCAL_LINKS`` links are left, one task finishes them.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = staged(links.distinct(), "links")
    state = None
    while True:
        if links.count() <= LOCAL_LINKS:
            return staged(links.coalesce(1).mapInArrow(_finish, "node long, root long"), "components")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.min("a")).alias("_low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
        large = staged(large.where("a <> b").distinct(), "links")
        low = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_low"))
        moved = large.join(low, F.col("a") == F.col("_a")).where("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        kept = low.select(F.col("_a").alias("a"), F.col("_low").alias("b"))
        links = staged(moved.unionByName(kept).distinct(), "links")
