"""Repeated passages by hash joins on strings of fixed length around sampled positions.

A byte is removed where a string of ``LENGTH`` bytes covering it also starts in a document with a smaller
id. This is not prefix doubling, there are no ranks of pairs of ranks: Spark groups positions by hashes of
strings of fixed lengths around them (16, 84, 33 and 50 bytes), positions whose string no other document shares
drop out, and the others go on to the next length, up to strings of the full length.

Sampling keeps this small without losing a match: of the strings of ``GRAM`` bytes inside every ``LENGTH``
bytes, the one with the smallest hash is an anchor. Equal strings have equal anchors, so two documents
that share a string share its anchor, and only anchors (about one position in eighteen) are compared.

1. Group by the anchor's gram, then by its context: all bytes of any string of full length around it. If an
   earlier document has the same context, all of it is removed, and the anchor is done. Only anchors whose
   gram is found in different contexts in different documents go on.
2. Group by the strings of ``HALF`` bytes that begin or end with the gram; every string of full length
   around the gram contains one of them. Strings no other document has drop out.
3. Group by the strings of full length that contain what is left.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing. Rows without id neither
lose bytes nor make others lose any. Rows that repeat an id are one document: they lose nothing to each
other, and each is compared with documents of smaller ids. An empty table gives an empty result. Other
columns of the input are ignored. Texts are staged once, in a table bucketed by document, so that the
rounds that need them do not shuffle them.
"""

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm.common import runs, staged, utf8
from tallyframe.session import shared_folder

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1  # grams in a string of full length
REACH = LENGTH - GRAM  # bytes before a gram that a string around it may hold
HALF = GRAM + (LENGTH - GRAM) // 2  # one of the two such strings is in every string around the gram
SHIFT = HALF - GRAM
PAD = 64  # zero bytes after every text, more than any string reaches beyond an anchor
STEP_BYTES = 1 << 20
OFFSETS = 30  # bits of a position; the checksum above them tells texts of one id apart

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(data):
    """The 8 bytes from each position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()


def _hashed(words, at, size):
    """Hashes of ``size`` bytes from each position of ``at``; the last word may overlap the one before."""
    out = np.full(len(at), np.uint64(size) * M2)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = _mixed((out ^ words[at + k]) * M1 + np.uint64(k))
    return out


def _sliding(values, size, least):
    """Least (or greatest) of each ``size`` consecutive values; shorter by ``size`` - 1."""
    pick = np.minimum if least else np.maximum
    span = 1
    while 2 * span <= size:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (size - span)], values[size - span :]) if span < size else values


def _laid_out(texts):
    """All texts in one array, each followed by zeros: (bytes, starts, lengths)."""
    pad = b"\0" * PAD
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join([pad, *(part for t in texts for part in (t, pad))]), np.uint8)
    return data, PAD + np.cumsum(lengths + PAD) - (lengths + PAD), lengths


def anchors(texts):
    """(text, offset, gram hash, context hash) arrays of the anchors of a list of byte strings."""
    data, starts, lengths = _laid_out(texts)
    words = _words(data)
    value = (_mixed((words[:-8] * M1) ^ _mixed(words[8:] * M2)) >> np.uint64(32)).astype(np.uint32)
    value = np.maximum(value, 1)
    least = _sliding(value, WINDOW, True)
    # Only strings inside a text count.
    inside = np.zeros(len(data) + 1, np.int8)
    long = lengths >= LENGTH
    inside[starts[long]] += 1
    inside[starts[long] + lengths[long] - LENGTH + 1] -= 1
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, 0)
    most = _sliding(np.concatenate([np.zeros(WINDOW - 1, np.uint32), least, np.zeros(WINDOW - 1, np.uint32)]), WINDOW, False)
    at = np.flatnonzero(most[: len(value)] == value)
    text = np.searchsorted(starts, at, "right") - 1
    offset = at - starts[text]
    gram = _hashed(words, at, GRAM)
    # The context reaches beyond the text where it is near an end; its extent is part of it.
    left, right = np.minimum(offset, REACH), np.minimum(lengths[text] - offset, LENGTH)
    first = at - left
    context = _mixed(gram + (left * 256 + right).astype(np.uint64) * M2)
    whole = (left == REACH) & (right == LENGTH)
    context[whole] ^= _hashed(words, first[whole], REACH + LENGTH)
    for extent in np.unique((left * 256 + right)[~whole]):
        some = np.flatnonzero((left * 256 + right == extent) & ~whole)
        context[some] ^= _hashed(words, first[some], int(extent) // 256 + int(extent) % 256)
    return text, offset, gram, _mixed(context)


def _steps(texts):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > STEP_BYTES or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _place(text, offset):
    """Positions as the rows carry them: the text's checksum above the offset."""
    return (np.array([zlib.crc32(t) for t in text], np.int64) << OFFSETS)[offset[0]] + offset[1]


RANKED = "gram int, context long, doc long, place long, stop int"


def _anchor_rows(batches):
    """Anchors of each batch (stop = -1). Of a batch's equal contexts only the smallest document goes on;
    what the others lose is known at once (stop = end of the removed bytes)."""
    names = ["gram", "context", "doc", "place", "stop"]
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t or b"" for t in utf8(batch.column(1))]
            found = []
            for a, b in _steps(texts):
                text, offset, gram, context = anchors(texts[a:b])
                place = _place(texts[a:b], (text, offset))
                found.append((gram, context, ids[a:b][text], place))
            if not found:
                continue
            gram, context, doc, place = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((doc, context))
            ranked = context[order]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
            smallest = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else doc
            # Rows keep the order of the texts: a document's rows lie together in every shuffle block.
            first = np.empty(len(order), bool)
            first[order] = doc[order] == smallest
            key = (gram >> np.uint64(33)).astype(np.int32)
            lost = _lost(doc[~first], place[~first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first], (lost[0] % 2147483647).astype(np.int32)])),
                    pa.array(np.concatenate([context[first].view(np.int64), np.zeros(len(lost[0]), np.int64)])),
                    pa.array(np.concatenate([doc[first], lost[0]])),
                    pa.array(np.concatenate([place[first], lost[1]])),
                    pa.array(np.concatenate([np.full(first.sum(), -1, np.int32), lost[2].astype(np.int32)])),
                ],
                names,
            )


def _lost(doc, place):
    """Intervals (doc, place of start, stop offset) around anchors, joined where they overlap."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    variant, offset = place >> OFFSETS, place & ((1 << OFFSETS) - 1)
    start, stop = np.maximum(offset - REACH, 0), offset + LENGTH
    if not len(doc):
        return doc, place, stop
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]) | (start[1:] > stop[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], (variant[begin] << OFFSETS) + start[begin], stop[end]


LOST = "doc long, place long, stop int"


def _by_context(batches):
    """Rows sorted by gram, context, document -> what is lost, and anchors to rank again (stop = -1).

    Only what is needed of the last gram is carried from batch to batch, however often it occurs.
    """
    gram = context = smallest = opened = None  # of the last row; smallest document of its gram's first context
    base, several, held = None, False, []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, c, d, p, stop = (batch.column(i).to_numpy() for i in range(5))
        known = stop >= 0
        out = [(d[known], p[known], stop[known].astype(np.int64))]
        g, c, d, p = g[~known], c[~known], d[~known], p[~known]
        if len(g):
            before_g = np.concatenate([[g[0] if gram is None else gram], g[:-1]])
            before_c = np.concatenate([[c[0] if gram is None else context], c[:-1]])
            new_gram = g != before_g
            new_gram[0] |= gram is None
            new = new_gram | (c != before_c)
            new[0] |= gram is None
            # The smallest document of each row's context, and of its gram's first context.
            index = np.arange(len(g))
            at = np.maximum.accumulate(np.where(new, index, -1))
            least = np.where(at >= 0, d[at], smallest if smallest is not None else 0)
            at_gram = np.maximum.accumulate(np.where(new_gram, index, -1))
            first = np.where(at_gram >= 0, d[at_gram], base if base is not None else 0)
            is_first = d == least
            out.append(_lost(d[~is_first], p[~is_first]))
            differs = new & (least != first)
            number = np.cumsum(new_gram)  # 0: the gram that was open before this batch
            wide = np.bincount(number, differs, number[-1] + 1) > 0
            wide[0] |= several
            last = number[-1]
            go_on = is_first & wide[number]
            if held and (wide[0] or last > 0):
                if wide[0]:
                    out += held
                held = []
            waiting = is_first & ~wide[number] & (number == last)
            mark = lambda rows: (d[rows], p[rows], np.full(rows.sum(), -1))  # noqa: B023, E731
            out.append(mark(go_on))
            if waiting.any():
                held.append(mark(waiting))
            gram, context, smallest, base, several = g[-1], c[-1], least[-1], first[-1], bool(wide[last])
        yield _intervals(out)


def _intervals(parts):
    columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["doc", "place", "stop"]
    )


def _both(offset, length):
    """For each anchor and side (0: beginning with its gram, 1: ending): (valid, start of the half string)."""
    return ((offset + HALF <= length, offset), (offset >= SHIFT, offset - SHIFT))


def _halves(batches):
    """(text, places) rows -> (half hash, doc, place * 2 + side) of the strings around each anchor."""
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t or b"" for t in utf8(batch.column(1))]
            places = batch.column(2).to_pylist()
            for a, b in _steps(texts):
                data, starts, lengths = _laid_out(texts[a:b])
                words = _words(data)
                counts = [len(x) for x in places[a:b]]
                text = np.repeat(np.arange(b - a), counts)
                place = np.array([x for row in places[a:b] for x in row], np.int64)
                offset = place & ((1 << OFFSETS) - 1)
                rows = []
                for side, (valid, start) in enumerate(_both(offset, lengths[text])):
                    some = np.flatnonzero(valid)
                    half = _mixed(_hashed(words, starts[text[some]] + start[some], HALF) + np.uint64(side))
                    rows.append((half.view(np.int64), ids[a:b][text[some]], place[some] * 2 + side))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*rows)], ["half", "doc", "place"]
                )


# Bytes that the strings of full length around an anchor span, by side, and how many of these strings
# there are; the string that holds both halves is counted with side 0.
SPANS = ((-SHIFT, LENGTH, SHIFT + 1), (-REACH, LENGTH - SHIFT - 1, REACH - SHIFT))


def _spans(batches):
    """(text, places, halves) rows -> (half, doc, place, first, last, bytes) for the strings of full length.

    ``first`` and ``last`` number the strings that lie inside the text.
    """
    names = ["half", "doc", "place", "first", "last", "bytes"]
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), [t or b"" for t in utf8(batch.column(1))]
        rows = [[] for _ in names]
        for i, (text, found) in enumerate(zip(texts, batch.column(2).to_pylist())):
            padded = b"\0" * PAD + text + b"\0" * PAD
            for item in found:
                place, side = divmod(item["place"], 2)
                offset = place & ((1 << OFFSETS) - 1)
                low, high, count = SPANS[side]
                first, last = max(0, -(offset + low)), min(count - 1, len(text) - LENGTH - offset - low)
                if first <= last:
                    at = PAD + offset
                    row = (item["half"], int(ids[i]), item["place"], first, last, padded[at + low : at + high])
                    for column, x in zip(rows, row):
                        column.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)


def _by_string(batches):
    """Spans sorted by half -> what is lost: strings of full length that an earlier document has."""
    width = max(high - low for low, high, _ in SPANS)
    most = max(count for _, _, count in SPANS)
    with np.errstate(over="ignore"):
        for table, starts in runs(batches):
            half, doc, item, first, last = (table.column(i).to_numpy() for i in range(5))
            # Spans of the shorter side are padded; their strings never reach the padding.
            data = b"".join(x.ljust(width, b"\0") for x in table.column(5).to_pylist()) + b"\0" * 8
            words = _words(np.frombuffer(data, np.uint8))
            rows = np.arange(len(half))
            lost = np.zeros((len(half), most + 1), bool)
            for k in range(most):
                some = rows[(first <= k) & (k <= last)]
                if not len(some):
                    continue
                key = _mixed(_hashed(words, some * width + k, LENGTH) + half[some].view(np.uint64))
                order = np.lexsort((doc[some], key))
                some, key = some[order], key[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                smallest = doc[some][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                lost[some, k] = doc[some] > smallest
            before = np.zeros_like(lost)
            before[:, 1:] = lost[:, :-1]
            begin = np.nonzero(lost & ~before)
            end = np.nonzero(~lost & before)
            row = begin[0]
            place = item[row] >> 1
            low = np.array([s[0] for s in SPANS])[item[row] & 1]
            offset = (place & ((1 << OFFSETS) - 1)) + low
            start, stop = offset + begin[1], offset + end[1] - 1 + LENGTH
            yield _intervals([(doc[row], ((place >> OFFSETS) << OFFSETS) + start, stop)])


def _removed(batches):
    """(doc_id, text, lost) rows -> the result."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for text, lost in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            out.append(_cut(text or b"", lost or [])[1:])
        columns = zip(*out) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names
        )


def _cut(text, lost):
    """(what remains, length, removed bytes, spans, digest of what remains)."""
    spans, done = [], -1
    for item in sorted((x["place"] & ((1 << OFFSETS) - 1), x["stop"]) for x in lost):
        start, stop = item[0], min(item[1], len(text))
        if start <= done:
            spans[-1][1] = done = max(done, stop)
        else:
            spans.append([start, stop])
            done = stop
    parts, at = [], 0
    for start, stop in spans:
        parts.append(text[at:start])
        at = stop
    rest = b"".join([*parts, text[at:]])
    return rest, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()


def _text_table(docs):
    """The texts as a table bucketed by (id, checksum of the text), below the shared folder."""
    spark = docs.sparkSession
    name = f"suffix_texts_{uuid.uuid4().hex}"
    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("variant")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), check, "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "suffix-texts")
    # The table stays until the last round: stronger compression than usual for files of a moment.
    rows.write.bucketBy(buckets, "doc", "variant").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def _beside_text(texts, rows, value, how):
    """Texts with the list of their rows' values; rows have doc and place."""
    lists = rows.select("doc", F.shiftright("place", OFFSETS).alias("variant"), value.alias("_v"))
    lists = lists.groupBy(F.col("doc").alias("_doc"), F.col("variant").alias("_variant")).agg(
        F.collect_list("_v").alias("_values")
    )
    joined = texts.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("variant") == F.col("_variant")), how)
    return joined.select("doc", "text", "_values")


def lost_intervals(docs, texts):
    """(doc, place, stop): bytes from the place's offset up to stop are removed; intervals may overlap."""
    ranked = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(_anchor_rows, RANKED)
    ranked = ranked.repartition("gram").sortWithinPartitions("gram", "context", "doc", "place")
    ranked = staged(ranked.mapInArrow(_by_context, LOST), "suffix-contexts")
    again = ranked.where("stop < 0").select("doc", "place")
    halves = _beside_text(texts, again, F.col("place"), "inner").mapInArrow(_halves, "half long, doc long, place long")
    halves = staged(halves, "suffix-halves")
    shared = halves.groupBy(F.col("half").alias("_half")).agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"))
    open_halves = halves.join(shared.where("_low < _high"), F.col("half") == F.col("_half")).select("half", "doc", "place")
    packed = open_halves.select("doc", F.shiftright("place", 1).alias("place"), F.struct("half", "place").alias("item"))
    spans = _beside_text(texts, packed, F.col("item"), "inner").mapInArrow(
        _spans, "half long, doc long, place long, first int, last int, bytes binary"
    )
    spans = spans.repartition("half").sortWithinPartitions("half", "doc")
    return ranked.where("stop >= 0").unionByName(spans.mapInArrow(_by_string, LOST))


def remove_repeats(docs):
    """One row per document: its bytes, those removed, in how many runs, and the digest of the rest."""
    texts = _text_table(docs)
    lost = lost_intervals(docs, texts)
    rows = _beside_text(texts, lost, F.struct("place", "stop"), "left")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
