"""Lines of delimited files regrouped into records, where quoted fields hold line breaks.

Files are read by blocks, many tasks a file, and a block may begin inside a quoted field. Whether a line ends
inside one depends on how it began, so every line is a map of two states: begun outside, begun inside. Maps are
composed over the lines of a block by the task that reads it, for both ways the block may begin, and the
blocks' maps over the blocks of a file. That tells how every block begins, and with it every line. Lines
that are records by themselves stay where they are; only the lines of longer records are shuffled, by record.

The records are written below the shared folder once, as later scans could cut the files into other blocks.

As in the parser, a quote opens a field only at the field's start, ``""`` stands for a quote inside it, and
what follows a closing quote up to the next separator belongs to the field. Line breaks inside fields become
a line feed. A field that is never closed would take in the rest of its file: such files are told apart
before any line is moved.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import col
from tallyframe.sources.files import BLOCK, POSITION, POSITION_COLUMNS, SOURCE, with_position, write_once

HEADER = -1  # the header's number
QUOTED = '"(?:[^"]++|"")*+'  # a quoted field up to its closing quote
MARKED = (
    f"{SOURCE} string, {BLOCK} long, {POSITION} long, value string, before0 boolean, before1 boolean, after0 boolean,"
    " after1 boolean, number0 long, number1 long, head boolean"
)


def _separator(sep):
    return "".join(f"\\x{{{ord(c):x}}}" for c in sep)


def _other(sep):
    """One character that does not begin a separator."""
    return f"[^{_separator(sep)}]" if len(sep) == 1 else f"(?:(?!{_separator(sep)})[\\s\\S])"


def _open_at_end(sep):
    """A line, read from a field's start, that ends inside a quoted field."""
    field = f'(?:{QUOTED}"{_other(sep)}*+|(?!"){_other(sep)}*+)'
    return f"(?:{field}{_separator(sep)})*+{QUOTED}\\z"


def ends_open(line, sep):
    """Whether a line that begins outside quotes ends inside; without a quote it cannot."""
    return F.contains(line, F.lit('"')) & line.rlike(f"^{_open_at_end(sep)}")


def stays_open(line, sep):
    """Whether a line that begins inside quotes ends inside."""
    onward = f'"{_other(sep)}*+{_separator(sep)}{_open_at_end(sep)}'
    return ~F.contains(line, F.lit('"')) | line.rlike(f'^(?:[^"]++|"")*+(?:\\z|{onward})')


def field_count(record, sep):
    """The fields of a record: separators outside quoted fields, and one."""
    parts = f'(^|{_separator(sep)}){QUOTED}(?:"|\\z)'
    bare = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, parts, "$1q")).otherwise(record)
    return ((F.length(bare) - F.length(F.replace(bare, F.lit(sep)))) / F.lit(len(sep)) + 1).cast("int")


def _states(opens, stays, start):
    """The state after each line, for a state before the first: the last map that ignores its input, then turns."""
    turns = np.cumsum(opens & ~stays)
    fixed = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
    since = np.where(fixed >= 0, opens[fixed] ^ (turns[fixed] & 1).astype(bool), start)
    return since ^ (turns & 1).astype(bool)


def _mark(batches):
    """Both ways each line may begin and end, the number of its record in the block if it begins there, and
    whether that is the header. Blank lines between records have no number of their own, nor has the header."""
    place, ways = None, "01"
    for batch in batches:
        source, block = (batch.column(c).to_pylist() for c in (SOURCE, BLOCK))
        position, opens, stays, filled = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in (POSITION, "opens", "stays", "filled")
        )
        out = {f"{name}{way}": np.zeros(len(position), bool) for name in ("before", "after") for way in ways}
        numbers = {way: np.zeros(len(position), np.int64) for way in ways}
        heads, begin = np.zeros(len(position), bool), 0
        while begin < len(position):
            if (source[begin], block[begin]) != place:
                place, state = (source[begin], block[begin]), {"0": False, "1": True}
                count, own, header = {"0": 0, "1": 0}, {"0": False, "1": False}, block[begin] != 0
                in_header = False
            # Batches hold few blocks: their ends are found by halving.
            low, high = begin, len(position) - 1
            while low < high:
                middle = (low + high + 1) // 2
                if (source[middle], block[middle]) == place:
                    low = middle
                else:
                    high = middle - 1
            part = slice(begin, low + 1)
            for way in ways:
                after = _states(opens[part], stays[part], state[way])
                before = np.concatenate([[state[way]], after[:-1]])
                starts = ~before & filled[part]
                if way == "0":
                    # The first filled line of a file, and the lines that go on with it.
                    head = np.zeros(len(before), bool)
                    if in_header:
                        head[: len(before) if before.all() else before.argmin()] = True
                    elif not header and starts.any():
                        at = starts.argmax()
                        rest = np.append(before[at + 1 :], False)
                        head[at : at + 1 + rest.argmin()] = True
                        header = True
                    in_header = bool(head[-1] and after[-1])
                    heads[part] = head
                    starts &= ~head
                seen = count[way] + np.cumsum(starts)
                begun = own[way] | (np.cumsum(~before) > 0)
                numbers[way][part] = np.where(begun, seen - 1, -1)
                out[f"before{way}"][part], out[f"after{way}"][part] = before, after
                state[way], count[way], own[way] = bool(after[-1]), int(seen[-1]), bool(begun[-1])
            begin = low + 1
        # Blank lines before the first record have none yet; they are left out anyway.
        found = [pa.array(np.maximum(n, 0), mask=n < 0) for n in numbers.values()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (*POSITION_COLUMNS, "value")),
             *(pa.array(out[c]) for c in ("before0", "before1", "after0", "after1")), *found, pa.array(heads)],
            [SOURCE, BLOCK, POSITION, "value", "before0", "before1", "after0", "after1", "number0", "number1", "head"],
        )


def _beginnings(marked):
    """Per block: whether it begins and ends inside quotes, and the record that goes on in it."""
    last = F.struct("after0", "after1", "number0", "number1", "head")
    blocks = marked.groupBy(SOURCE, BLOCK).agg(F.max_by(last, POSITION).alias("l")).select(SOURCE, BLOCK, "l.*")
    upto = Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy(SOURCE).orderBy(BLOCK)
    blocks = blocks.withColumn("turns", F.sum((F.col("after0") & ~F.col("after1")).cast("int")).over(upto))
    known = F.when(F.col("after0") == F.col("after1"), (F.col("after0").cast("int") + F.col("turns")) % 2)
    blocks = blocks.withColumn("known", F.last(known, ignorenulls=True).over(upto))
    blocks = blocks.withColumn("ends", (F.coalesce("known", F.lit(0)) + F.col("turns")) % 2 == 1)
    blocks = blocks.withColumn("begins", F.lag("ends", 1, False).over(order))
    number = F.when(F.col("begins"), F.col("number1")).otherwise(F.col("number0"))
    begun = number.isNotNull() | F.col("head")
    place = F.when(begun, F.struct(F.col(BLOCK).alias("block"), number.alias("number"), F.col("head").alias("head")))
    blocks = blocks.withColumn("going", F.last(place, ignorenulls=True).over(upto))
    return blocks.select(
        F.col(SOURCE).alias("__file"), F.col(BLOCK).alias("__block"), "begins", "ends",
        F.lag("going").over(order).alias("going"),
    )


def regroup(spark, paths, sep):
    """``(records, headers, unclosed)`` of files with a header.

    ``records``: place columns, ``record``, ``fields``; records are numbered from 0 in the block they begin in. Blank
    lines between records are left out. ``headers``: ``path, record``. ``unclosed``: ``path`` of files with a
    quoted field that never ends, none of whose records are given.
    """
    line = F.col("value")
    lines = with_position(spark.read.text(paths)).select(
        *POSITION_COLUMNS, "value", ends_open(line, sep).alias("opens"), stays_open(line, sep).alias("stays"),
        (F.trim("value") != "").alias("filled"),
    )
    marked = lines.mapInArrow(_mark, MARKED)
    blocks = write_once(_beginnings(marked), "blocks")
    unclosed = blocks.groupBy("__file").agg(F.max_by("ends", "__block").alias("ends")).where("ends").select(F.col("__file").alias("path"))
    same = (F.col(SOURCE) == F.col("__file")) & (F.col(BLOCK) == F.col("__block"))
    found = marked.join(blocks.drop("ends"), same, "left").join(unclosed, F.col(SOURCE) == F.col("path"), "left_anti")
    pick = lambda name: F.when(F.col("begins"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    found = found.select(
        *POSITION_COLUMNS, "value", pick("before").alias("before"), pick("after").alias("after"),
        pick("number").alias("number"), "head", "going",
    ).where("before OR after OR trim(value) <> ''")
    here = F.col("number").isNotNull() | F.col("head")
    found = found.select(
        SOURCE, F.when(here, F.col(BLOCK)).otherwise(F.col("going.block")).alias("block"),
        F.when(F.when(here, F.col("head")).otherwise(F.col("going.head")), F.lit(HEADER))
        .when(here, F.col("number")).otherwise(F.col("going.number")).alias("number"),
        (F.col("before") | F.col("after")).alias("long"), F.struct(BLOCK, POSITION, "value").alias("line"),
    )
    single = found.where("NOT long").select(SOURCE, "block", "number", F.col("line.value").alias("record"))
    longer = found.where("long").groupBy(SOURCE, "block", "number").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    longer = longer.select(SOURCE, "block", "number", F.array_join("lines.value", "\n").alias("record"))
    records = single.unionAll(longer).select(
        SOURCE, F.col("block").alias(BLOCK), F.col("number").alias(POSITION), "record",
        field_count(F.col("record"), sep).alias("fields"),
    )
    records = write_once(records, "records")
    is_header = F.col(POSITION) == HEADER
    return records.where(~is_header), records.where(is_header).select(F.col(SOURCE).alias("path"), "record"), unclosed


def parse(records, header, sep, corrupt_column=None):
    """The records' fields as text columns; missing fields are null, fields beyond the header are left out."""
    names = [f"c{i}" for i in range(len(header))]
    kept = [*names, "broken"] if corrupt_column else names
    options = {
        "sep": sep, "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(20_480, len(header) + 16)),
        "columnNameOfCorruptRecord": "broken",
    }
    fields = F.from_csv("record", ", ".join(f"{n} string" for n in kept), options)
    parsed = records.select(*map(col, POSITION_COLUMNS), fields.alias("f"))
    extra = [F.col("f.broken").alias(corrupt_column)] if corrupt_column else []
    return parsed.select(*[F.col(f"f.{n}").alias(h) for n, h in zip(names, header)], *extra, *map(col, POSITION_COLUMNS))
