"""Sharding indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays together. Differencing keeps a heap of partial partitions,
each a tuple of loads, one per shard; it takes the two with the largest spread (largest minus smallest
load) and adds them in opposite order, largest on smallest, until one partition is left.

Groups are far too many for one task, so differencing runs in levels. Each level deals its items into
buckets of bounded number by hash, splits every bucket into nearly equal parts, and hands the parts on as
the next level's items, until one bucket is left; it is split into the shards. Two kinds of items go
straight to the last level: those so large that they matter by themselves, of which there are never more
than ``shards * HEAVY``, and a few small ones, which even out what the parts leave over.

Defined results: a null text counts as an empty one (no bytes, group of the empty texts). Repeated rows
each keep a slot. A group larger than a fair share fills a shard by itself; the others share the rest.
An empty table gives an empty result. Other columns of the input are ignored.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyframe.llm.common import running_start, spread, staged

SHARDS = 40
ROW_BYTES = 16  # counted for a row besides its text
BUCKET_ITEMS = 20_000
HEAVY = 16  # items of more than 1 / (shards * HEAVY) of all bytes are held back for the last level
FINE_ITEMS = 5_000  # and about so many others
LAST_ITEMS = 10_000  # parts that the level before the last hands on, at most
LEAST_PARTS = 8  # of a bucket
MOST_PARTS = 500  # with ``BUCKET_ITEMS``, the loads and orders of a bucket's merges take some 50 MB
ROWS_PER_BUCKET = 20_000


def difference(sizes, parts):
    """The part, 0 .. parts-1, of each item."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    # A partial partition is (loads ascending, how they came about): a leaf item or a merge of two.
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    loads = {}
    merges = []
    single = np.zeros(parts, np.int64)

    def tuple_of(node):
        if node >= n:
            return loads.pop(node)
        out = single.copy()
        out[-1] = sizes[node]
        return out

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        summed = tuple_of(a) + tuple_of(b)[::-1]
        order = np.argsort(summed, kind="stable").astype(np.int32)
        node = n + len(merges)
        merges.append((a, b, order))
        loads[node] = summed[order]
        heapq.heappush(heap, (-int(summed[order[-1]] - summed[order[0]]), node))
    # From the last merge down: where each position of a partial partition ends up.
    part = np.zeros(n, np.int64)
    if not merges:
        part[0] = parts - 1
        return part
    places = {n + len(merges) - 1: np.arange(parts)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        ends = np.empty(parts, np.int64)
        ends[order] = places.pop(n + i)
        for child, where in ((a, ends), (b, ends[::-1])):
            if child < n:
                part[child] = where[-1]
            else:
                places[child] = where
    return part


def _split(items, parts):
    """Adds ``_part`` to items (_id, _size, _bucket), bucket by bucket."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_id"], ascending=[False, True], kind="stable")
        return frame.assign(_part=difference(frame["_size"].to_numpy(np.int64), parts))

    schema = "_id string, _size long, _bucket long, _part long"
    return items.select("_id", "_size", "_bucket").groupBy("_bucket").applyInPandas(split, schema)


def assign_groups(groups, shards=SHARDS):
    """(_id, _shard) for groups (_id string, _size long), ids unique."""
    groups = staged(groups, "shard-groups")
    total, count = groups.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    level, levels, held = groups, [], None
    while count > BUCKET_ITEMS:
        if held is None:
            fine = F.pmod(F.xxhash64(F.lit("fine"), "_id"), F.lit(max(1, count // FINE_ITEMS))) == 0
            back = (F.col("_size") > total / (shards * HEAVY)) | fine
            held, level = level.where(back), level.where(~back)
        buckets = -(-count // BUCKET_ITEMS)
        parts = min(MOST_PARTS, max(LEAST_PARTS, LAST_ITEMS // buckets))
        bucketed = level.withColumn("_bucket", spread(["_id"], count, BUCKET_ITEMS))
        split = staged(_split(bucketed, parts), "shard-level")
        levels.append(split)
        level = split.groupBy("_bucket", "_part").agg(F.sum("_size").alias("_size"))
        level = staged(level.select(_inner("_bucket", "_part").alias("_id"), "_size"), "shard-parts")
        count = level.count()
    if held is not None:
        # Ids of parts and of groups never meet: a part's has a colon, a digest has none.
        level = level.unionByName(held)
    done = staged(_split(level.withColumn("_bucket", F.lit(0).cast("long")), shards), "shard-last")
    done = done.select("_id", F.col("_part").cast("int").alias("_shard"))
    if held is None:
        return done
    kept, done = done.where(~F.col("_id").contains(":")), done.where(F.col("_id").contains(":"))
    for split in reversed(levels):
        up = done.select(F.col("_id").alias("_up"), "_shard")
        done = split.join(up, _inner("_bucket", "_part") == F.col("_up")).select("_id", "_shard")
    return done.unionByName(kept)


def _inner(bucket, part):
    return F.concat_ws(":", F.col(bucket), F.col(part))


def shard(docs, shards=SHARDS):
    """One row per document: its size, its text's checksum, its shard and its slot there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("_id"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("_id").agg(F.sum("size").alias("_size"))
    placed = assign_groups(groups, shards)
    # A group's rows are many, its shard is one row; adaptive execution splits a large group's rows.
    placed = staged(rows.join(placed, "_id").withColumnRenamed("_shard", "shard"), "shard-placed")
    placed = placed.withColumn("_bucket", spread(["doc_id", "_id"], rows.count(), ROWS_PER_BUCKET))
    placed = placed.withColumn("_one", F.lit(1).cast("long"))
    order = [F.xxhash64("doc_id", "_id"), F.col("doc_id"), F.col("_id")]
    numbered = running_start(placed, ["shard"], "_bucket", order, "_one", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
