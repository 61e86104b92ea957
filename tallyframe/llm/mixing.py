"""Mixing sources to target weights, by blocks drawn through index permutations.

The words of a source, in a hashed document order, form one stream that is cut into blocks of a fixed
number of words. Each source has as many slots in the mix as its target needs. The output shards draw
how many slots of each source they hold, multinomially from what is left of the targets, so that all
slots are dealt out. Slot numbers pass through a pseudorandom permutation of the source's block
numbers, one permutation per round over the source, and the blocks are joined by their number.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating. They share 150 % of all
words; a target stops at twice its source's words, and what it can't use goes to the others by weight.
Since no round repeats a block and no source has more than two rounds, no word is taken more than twice.

Defined results: null text has no words; documents without words take nothing. A null source is a
source of its own. Repeated rows are documents of their own; rows with equal id, source and size are
interchangeable. An empty table gives an empty result. Other columns of the input are ignored.
The driver sees one row per source (names and sums), never documents or blocks.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.functions.local import local_table
from tallyframe.llm.common import WORD, give_back, running_start, slices, spread, staged, utf8

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
BLOCK_WORDS = 2048
SHARDS = 64
ROWS_PER_BUCKET = 20_000
FEISTEL_ROUNDS = 4


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes):
    """Words to take per source: ``sizes`` in source order -> floats in the same order."""
    sizes = np.asarray(sizes, np.float64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], np.float64)
    limits = MOST_REPEATS * sizes
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    total = SHARE_PERCENT / 100 * sizes.sum()
    while not full.all():
        share = (total - limits[full].sum()) * weights / weights[~full].sum()
        target = np.where(full, limits, share)
        above = ~full & (target > limits)
        if not above.any():
            break
        full |= above
    return np.where(full, limits, target)


def draw_shards(slots, shards, seed):
    """How many slots of each source every shard holds: (shards, sources), columns adding up to ``slots``."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    drawn = np.zeros((shards, len(left)), np.int64)
    for shard in range(shards):
        wanted = -(-left.sum() // (shards - shard))
        while wanted > 0:
            take = np.minimum(rng.multinomial(wanted, left / left.sum()), left)
            drawn[shard] += take
            left -= take
            wanted -= take.sum()
    return drawn


def _mix(x):
    """A fixed 64-bit mixing of integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index, size, seed, inverse=False):
    """Images of ``index`` under a keyed permutation of 0 .. size-1, or its inverse, elementwise.

    A Feistel network permutes the next power of four; numbers that leave the range go through again.
    """
    index, size, seed = (np.array(np.broadcast_to(x, np.shape(index)), np.uint64) for x in (index, size, seed))
    one = np.uint64(1)
    bits = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2) + 0.5) / 2).astype(np.uint64)
    mask = (one << bits) - one
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        left, right, low = out[todo] >> bits[todo], out[todo] & mask[todo], mask[todo]
        keys = [seed[todo] * np.uint64(FEISTEL_ROUNDS) + np.uint64(r + 1) for r in range(FEISTEL_ROUNDS)]
        if inverse:
            for key in reversed(keys):
                left, right = right ^ (_mix(left + key) & low), left
        else:
            for key in keys:
                left, right = right, left ^ (_mix(right + key) & low)
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def permuted_index(index, size, seed):
    """The same on columns."""

    @arrow_udf("long")
    def permute(index: pa.Array, size: pa.Array, seed: pa.Array) -> pa.Array:
        number = lambda x: x.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            return pa.array(permuted(number(index), number(size), number(seed)))

    return permute(index, size, seed)


def placed(docs):
    """(doc_id, source, size, start): each row's words in its source's stream."""
    sizes = staged(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    sizes = sizes.withColumn("_bucket", spread(["source", "doc_id", "size"], sizes.count(), ROWS_PER_BUCKET))
    order = [F.xxhash64("doc_id", "size"), F.col("doc_id"), F.col("size")]
    return staged(running_start(sizes, ["source"], "_bucket", order, "size", "start").drop("_bucket"), "mix-placed")


def plan(documents, block_words=BLOCK_WORDS, shards=SHARDS, seed=0):
    """Sources with their sizes and targets, and the drawn slots of every shard, from placed documents."""
    sums = documents.groupBy("source").agg(F.sum("size").alias("words")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = np.array([r.words for r in sums], np.int64)
    wanted = targets(sizes)
    rows = []
    # The last block of a stream may be short, and where the permutation puts it is its own affair:
    # a source's last round takes blocks until its target is met, the last of them in part.
    whole = np.minimum(np.floor(wanted + 0.5).astype(np.int64), MOST_REPEATS * sizes)
    blocks = -(-sizes // block_words)
    for i, row in enumerate(sums):
        if not sizes[i]:
            rows.append((row.source, i, 0, float(wanted[i]), 0, 0, 0, 0, 0, -1))
            continue
        rounds, rest = divmod(int(whole[i]), int(sizes[i]))
        last = int(sizes[i] - (blocks[i] - 1) * block_words)
        with np.errstate(over="ignore"):
            where = int(permuted([blocks[i] - 1], blocks[i], seed + i * 16 + rounds, inverse=True)[0])
        slots = rounds * int(blocks[i]) + _slots_for(rest, int(blocks[i]), block_words, last, where)
        rows.append((row.source, i, int(sizes[i]), float(wanted[i]), int(blocks[i]), last, rounds, rest, slots, where))
    drawn = draw_shards([r[8] for r in rows], shards, seed) if rows and sum(r[8] for r in rows) else None
    return rows, drawn


def _slots_for(words, blocks, block_words, last, where):
    """Slots of a round that take at least one of ``words``."""
    if words <= 0:
        return 0
    slots = -(-words // block_words)
    if slots > where:  # the short block is among them
        slots = max(where + 1, -(-(words + block_words - last) // block_words))
    return min(slots, blocks)


SOURCE_COLUMNS = (
    "source string, _s int, source_size long, target double, _blocks long, _last long, _rounds long, "
    "_rest long, _slots long, _where long"
)


def slots(spark, rows, drawn, block_words=BLOCK_WORDS, seed=0):
    """(s, round, slot, index, take, shard): one row per slot of the mix, ``take`` words from the block's start."""
    spans = []
    starts = np.zeros(len(rows), np.int64)
    for shard in range(0 if drawn is None else len(drawn)):
        for i in np.flatnonzero(drawn[shard]):
            spans.append((int(i), shard, int(starts[i]), int(starts[i] + drawn[shard][i])))
            starts[i] += drawn[shard][i]
    spans = local_table(spark, spans, "_s int, shard int, _from long, _to long")
    about = local_table(spark, rows, SOURCE_COLUMNS).drop("source", "source_size", "target", "_slots")
    # Both tables have at most shards x sources rows. Shares are dealt out before they are unrolled,
    # so that one source's slots are made by all tasks.
    step = 1 << 16
    spans = spans.select(
        "_s", "shard", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(step))).alias("_from"), "_to"
    )
    spans = spans.repartition(F.col("_s"), F.col("shard"), F.col("_from")).join(F.broadcast(about), "_s")
    numbered = spans.select(
        "*", F.explode(F.sequence("_from", F.least(F.col("_to"), F.col("_from") + step) - 1)).alias("_n")
    ).select(
        "_s", "shard", "_blocks", "_last", "_rounds", "_rest", "_where",
        F.expr("_n div _blocks").alias("round"), F.expr("_n % _blocks").alias("slot"),
    )
    before = F.col("slot") * block_words - F.when(F.col("slot") > F.col("_where"), block_words - F.col("_last")).otherwise(0)
    take = F.when(F.col("round") < F.col("_rounds"), F.lit(block_words)).otherwise(
        F.least(F.lit(block_words), F.col("_rest") - before)
    )
    key = F.lit(seed) + F.col("_s") * 16 + F.col("round")
    return numbered.select(
        "_s", "shard", "round", "slot", permuted_index("slot", "_blocks", key.cast("long")).alias("index"),
        take.alias("take"),
    )


def pieces(documents, about, block_words=BLOCK_WORDS):
    """(s, index, offset, length, from): each document's share of every block it reaches into."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    named = documents.where("size > 0").join(
        F.broadcast(about.select(F.col("source").alias("_name"), "_s")), F.col("source").eqNullSafe(F.col("_name"))
    )
    cut = named.select("*", F.explode(F.sequence(first, last)).alias("index")).drop("_name")
    begin = F.greatest(F.col("start"), F.col("index") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block_words)
    return cut.select(
        "*", (begin - F.col("index") * block_words).alias("offset"), (end - begin).alias("length"),
        (begin - F.col("start")).alias("from"),
    )


def mix(docs, block_words=BLOCK_WORDS, shards=SHARDS, seed=0):
    """The mix and its basis.

    Returns (documents, about, parts): placed documents; a small table of sources with ``source_size``
    and ``target``; and one row per piece taken: the document's columns, ``shard``, ``round``, ``slot``,
    and ``length`` words of the document after its first ``from`` words.
    """
    spark = docs.sparkSession
    documents = placed(docs)
    rows, drawn = plan(documents, block_words, shards, seed)
    about = local_table(spark, rows, SOURCE_COLUMNS)
    dealt = slots(spark, rows, drawn, block_words, seed)
    # A block belongs to one source and has at most two slots, so no key of this join is hot.
    parts = pieces(documents, about, block_words).join(dealt, ["_s", "index"])
    length = F.least(F.col("length"), F.col("take") - F.col("offset"))
    parts = parts.withColumn("length", length).where("length > 0")
    return documents, about, parts.select(*documents.columns, "shard", "round", "slot", "offset", "from", "length")


def mix_table(docs, block_words=BLOCK_WORDS, shards=SHARDS, seed=0):
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    documents, about, parts = mix(docs, block_words, shards, seed)
    # A row with words is alone at its place in its source's stream.
    taken = parts.groupBy(F.col("source").alias("_source"), F.col("start").alias("_start")).agg(
        F.sum("length").alias("_taken")
    )
    at = F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    sources = about.select(F.col("source").alias("_name"), "source_size", "target")
    return (
        documents.join(taken, at, "left")
        .join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_name")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs, block_words=BLOCK_WORDS, shards=SHARDS, seed=0):
    """The mix as documents: one row per piece taken, with the columns of ``docs`` and the piece's text.

    ``n_chars``, where there is such a column, is the length of the piece. Everything else is the document's.
    """
    documents, _, parts = mix(docs, block_words, shards, seed)
    # Rows with equal id, source and size are interchangeable, so numbering them on both sides pairs
    # every row with one place. The texts are shuffled once.
    same = Window.partitionBy("_id", "_source", "_size")
    wanted = parts.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.col("start").alias("_start"), F.col("from").alias("_from"), F.col("length").alias("_length"),
    )
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), count_words(F.col("text")).alias("_size"),
        F.col("text").alias("_text"), F.struct("*").alias("_row"),
    ).where("_size > 0")
    # A document none of whose words are taken has no place, so places are numbered among all documents.
    places = documents.where("size > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.col("start").alias("_start"), F.row_number().over(
            Window.partitionBy("doc_id", "source", "size").orderBy("start")
        ).alias("_n"),
    )
    wanted = _null_safe(wanted, places, ["_id", "_source", "_size", "_start"])
    rows = rows.withColumn("_n", F.row_number().over(same.orderBy(F.xxhash64("_text"))))
    out = _null_safe(rows, wanted, ["_id", "_source", "_size", "_n"])
    text = words_between(F.col("_text"), F.col("_from"), F.col("_length"), F.col("_size"))
    out = out.select("_row", text.alias("_piece"))
    kinds = dict(docs.dtypes)
    return out.select(
        *[
            F.col("_piece").alias(c) if c == "text"
            else F.length("_piece").cast(kinds[c]).alias(c) if c == "n_chars"
            else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def _null_safe(left, right, keys):
    """An inner join in which null keys match, with the left side's keys."""
    right = right.select(*[F.col(c).alias(f"{c}_r") if c in keys else F.col(c) for c in right.columns])
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys])
    return joined.drop(*[f"{k}_r" for k in keys])


def words_between(text, start, count, size):
    """The part of ``text`` from its word number ``start`` over ``count`` words, as it stands there."""

    @arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, counts: pa.Array, sizes: pa.Array) -> pa.Array:
        word, out, parts = re.compile(WORD.encode()), [], slices(texts)
        rows = zip((t for part in parts for t in utf8(part)), starts.to_pylist(), counts.to_pylist(), sizes.to_pylist())
        for t, s, n, size in rows:
            if n < size:
                found = itertools.islice(word.finditer(t), s, s + n)
                first = last = next(found)
                for last in found:
                    pass
                t = t[first.start() : last.end()]
            out.append(t)
        done = pa.array(out, pa.string())
        out.clear()
        give_back()
        return done

    return cut.asNondeterministic()(text, start, count, size)
