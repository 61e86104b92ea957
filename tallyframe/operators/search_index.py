"""Text search that skips files: a filter of the three-character sequences (trigrams) in each file.

A file's filter is a bit map of hashed trigrams of its lower-cased displayed texts, kept in pieces of 4 KB. A text
can only contain a needle if its file's filter has all the needle's trigrams; files that pass are read and checked
exactly, as are files that the index does not know yet, so results are those of ``search_rows``. A needle of fewer
than three characters passes every file.
"""

from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import col, text_of
from tallyframe.operators.search import search_rows
from tallyframe.sources.file_states import add_states, changed_files, read_states
from tallyframe.sources.files import SOURCE, POSITION_COLUMNS, readable_path
from tallyframe.sources.parquet import read_parquet

PIECE = 1 << 15  # bits of one bit map of Spark's
PIECES = 32
NEEDLE_TRIGRAMS = 64  # more are not looked up; files that pass are checked exactly anyway
STATE_SCHEMA = "columns array<string>, piece int, bits binary"


def _hashes(text):
    """Distinct hashes of a text's trigrams; its characters are split once, so long texts cost no more per character."""
    chars = F.split(text, "")

    def hashed(chars):
        starts = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        three = lambda i: F.xxhash64(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2))
        return F.transform(starts, lambda i: F.pmod(three(i), F.lit(PIECE * PIECES)).cast("int"))

    # The characters are bound to a name, or they would be split again for each trigram.
    return F.array_distinct(F.flatten(F.transform(F.array(chars), hashed)))


def read_files(spark, paths):
    return read_parquet(spark, paths, positions=True)


def update_index(spark, path, folder, columns=None, read=read_files):
    """Bring the index at ``path`` up to date with the files directly in ``folder``; returns the files read.

    ``columns`` (default all) must be the same from update to update. New and changed files are read, those that
    are gone are forgotten. ``read(spark, paths)`` returns rows with the column ``_source_file``.
    """
    states = read_states(spark, path, STATE_SCHEMA)
    fresh, gone = changed_files(spark, states, folder)
    paths = [row.file for row in fresh.collect()]
    if not paths and gone.isEmpty():
        return 0
    rows = None
    if paths:
        df = read(spark, [readable_path(p) for p in paths])
        chosen = list(columns or [c for c in df.columns if c not in POSITION_COLUMNS])
        require_some(chosen, "The table has no columns.")
        require_columns(df, [*chosen, SOURCE])
        _require_same_columns(states, chosen)
        rows = fresh.join(_file_maps(df, chosen), "file", "left").withColumn("columns", F.array(*map(F.lit, chosen)))
    add_states(spark, path, rows, gone)
    return len(paths)


def _file_maps(df, chosen):
    """``file``, ``piece``, ``bits``: the filter of each file of ``df`` over the texts of ``chosen``.

    Spark builds bit maps by sorting their rows, so each file's hashes are made distinct first, by hashing: a task
    then sorts at most a million rows a file, however long the files are.
    """
    texts = F.array(*[F.lower(text_of(df, c)) for c in chosen])
    cells = df.select(col(SOURCE).alias("file"), F.explode(texts).alias("text")).where("text IS NOT NULL")
    bits = cells.select("file", F.explode(_hashes(F.col("text"))).alias("hash")).distinct()
    return bits.groupBy("file", F.expr(f"CAST(hash DIV {PIECE} AS INT)").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("hash") % PIECE).alias("bits")
    )


def _require_same_columns(states, columns):
    stored = states.select("columns").first()
    if stored and list(stored.columns) != list(columns):
        raise ValueError(f"The index was made for other columns: {list(stored.columns)}")


def candidate_files(spark, path, folder, needle):
    """``file``: the files directly in ``folder`` that may contain ``needle``, unknown ones included."""
    states = read_states(spark, path, STATE_SCHEMA)
    fresh, gone = changed_files(spark, states, folder)
    text = F.lit(needle.lower())
    wanted = sorted(spark.range(1).select(_hashes(text).alias("hashes")).first().hashes)[:NEEDLE_TRIGRAMS]
    passing = states.join(gone.select("file"), "file", "left_anti")
    passing = passing.join(fresh.select("file"), "file", "left_anti")
    hits = F.lit(0)
    for hashed in wanted:
        piece, place = divmod(hashed, PIECE)
        byte = F.conv(F.hex(F.substring("bits", place // 8 + 1, 1)), 16, 10).cast("int")
        hits = hits + F.when(F.col("piece") == piece, F.getbit(byte, F.lit(place % 8)).cast("int")).otherwise(0)
    passing = passing.groupBy("file").agg(F.sum(hits).alias("hits")).where(F.col("hits") == len(wanted))
    return passing.select("file").unionAll(fresh.select("file"))


def search_indexed(spark, path, folder, needle, columns=None, read=read_files):
    """Rows of the files in ``folder`` that show ``needle`` in any of ``columns`` (default and at most the indexed ones).

    The driver sees the paths of the files that are read. If no file passes, one known file is named for its types
    and no row is read; a folder without files is an error.
    """
    states = read_states(spark, path, STATE_SCHEMA)
    stored = states.select("columns").first()
    indexed = list(stored.columns) if stored else columns
    if columns and set(columns) - set(indexed):
        raise ValueError(f"Not in the index: {sorted(set(columns) - set(indexed))}")
    paths = [row.file for row in candidate_files(spark, path, folder, needle).orderBy("file").collect()]
    if not paths:
        _, gone = changed_files(spark, states, folder)
        there = states.select("file").join(gone, "file", "left_anti").first()
        if there is None:
            raise ValueError(f"There are no files in {folder}.")
        return read(spark, [readable_path(there.file)]).where(F.lit(False))
    df = read(spark, [readable_path(p) for p in paths])
    shown = columns or indexed or [c for c in df.columns if c not in POSITION_COLUMNS]
    return search_rows(df, needle, shown)
