"""Packing token sequences online by sum of squares.

Every task packs the documents it reads, in their order, without a shuffle. What a document has beyond
whole sequences goes into the open window whose fill level makes the sum of squared counts of partially
filled windows smallest; an array holds how many windows stand at each level. Squares keep the levels
spread evenly, so that a fitting window is nearly always open. When a task ends, or too many windows are
open, what is left in them is laid end to end and cut into full sequences, and the last rest is cut into
sequences of power-of-two length, which need no padding.

Defined results: null text is empty, and an empty text is one piece holding the end id alone. Rows are
packed each on their own, whatever their id. An empty table gives an empty result. Other columns of the
input are ignored. Sequence ids are unique; their gaps tell the tasks apart. A task that is run again
reads the same rows and packs them alike, as long as its input is stored (a table, files).
"""

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from tallyframe.llm.common import utf8

LENGTH = 4096
END_ID = 2
OPEN_WINDOWS = 2048  # open at most in a task; beyond, their contents are cut into full sequences
CACHED_WORDS = 800_000
CACHED_BYTES = 64  # longest word that is remembered
STEP_BYTES = 1 << 20  # of text, or one longer document, encoded at a time

PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary(name="word_bpe_49k.json"):
    """The path of a public tokenizer's file, to be opened inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Grown:
    """A numpy array that values are appended to."""

    def __init__(self, values, kind):
        self.data, self.size = np.array(values, kind), len(values)

    def append(self, values):
        size = self.size + len(values)
        if size > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(size, len(self.data)), self.data.dtype)])
        self.data[self.size : size] = values
        self.size = size


class Encoder:
    """Ids of whole texts, one word at a time.

    The tokenizer never joins characters across the white space that separates words, so the ids of a
    text are those of its words; each new word is encoded once, as long as a worker remembers it.
    """

    opened = {}

    def __init__(self, path, end_id=END_ID, remembered=None):
        self.remembered = CACHED_WORDS if remembered is None else remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()

    @classmethod
    def of(cls, *arguments):
        """The worker's encoder, which outlives a task."""
        if arguments not in cls.opened:
            cls.opened[arguments] = cls(*arguments)
        return cls.opened[arguments]

    def clear(self):
        self.index = {None: 0}  # None ends a text
        self.starts, self.lengths = Grown([0], np.int64), Grown([1], np.int64)
        self.ids = Grown([self.end_id], np.uint32)

    def _learn(self, words):
        encoded = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False
        )
        encoded = [e.ids for e in encoded]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.index.update(zip(words, range(self.starts.size, self.starts.size + len(words))))
        self.starts.append(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths.append(lengths)
        self.ids.append(np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, lengths.sum()))

    def encode(self, texts):
        """A list of id arrays, each with the end id, for a list of UTF-8 texts or None."""
        if self.starts.size > self.remembered:
            self.clear()
        words, ends = [], []
        for text in texts:
            words += (text or b"").split()
            words.append(None)
            ends.append(len(words))
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            self._learn(new)
            at[unknown] = [self.index[words[i]] for i in unknown]
            for word in new:
                if len(word) > CACHED_BYTES:
                    del self.index[word]
        lengths = self.lengths.data[at]
        stops = np.cumsum(lengths)
        places = np.arange(stops[-1] if len(stops) else 0)
        places += np.repeat(self.starts.data[at] - (stops - lengths), lengths)
        ids = self.ids.data[places]
        bounds = [0, *(int(stops[e - 1]) for e in ends)]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class Packer:
    """Windows of one task. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, emit, length=LENGTH, open_windows=OPEN_WINDOWS):
        self.emit, self.length, self.most = emit, length, open_windows
        self.counts = np.zeros(length + 1, np.int64)  # windows at each fill level
        self.windows = {}  # level -> windows, each a list of pieces
        self.open = 0

    def add(self, doc, ids):
        total = len(ids)
        whole = total - total % self.length
        for start in range(0, whole, self.length):
            self.emit([(doc, start, ids[start : start + self.length], total)])
        if whole < total:
            # Copied, as a slice would keep all that was encoded with it.
            self._place((doc, whole, ids[whole:].astype(np.uint16 if ids.max() < 1 << 16 else np.uint32), total))

    def _place(self, piece):
        size, length = len(piece[2]), self.length
        # Change of the sum of squares for each level from 0 (a new window) to the last that leaves room.
        left = self.counts[: length - size + 1]
        arrive = 2 * self.counts[size:] + 1
        arrive[-1] = 0  # a full window is not counted
        change = np.where(left > 0, arrive - 2 * left + 1, np.iinfo(np.int64).max)
        change[0] = arrive[0]
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
        window = []
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        window.append(piece)
        level += size
        if level == length:
            self.emit(window)
            return
        self.windows.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1
        if self.open > self.most:
            self.flush(False)

    def flush(self, last=True):
        """Cuts what is open into full sequences, and at the end the rest into powers of two."""
        pieces = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.counts[:], self.windows, self.open = 0, {}, 0
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left >= self.length or (last and left):
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc, start, ids, total))
                room -= len(ids)
            self.emit(window)
        for piece in reversed(pieces):
            self._place(piece)


def steps(batch):
    """The batch in pieces of about ``STEP_BYTES`` of text, as a text's words take many times its size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes, dtype=np.int64) // STEP_BYTES
    starts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], len(sizes))):
        yield batch.slice(a, b - a)


def pack(docs, path=None, length=LENGTH, end_id=END_ID, with_ids=False, remembered=CACHED_WORDS):
    """One row per piece of a document; ``with_ids`` adds the piece's ids, little-endian 32-bit, as binary.

    A worker remembers the ids of at most ``remembered`` words, some 200 bytes each, between tasks.
    """
    path = path or vocabulary()
    kind = dict(docs.dtypes)["doc_id"]
    schema = PIECES.format(kind=kind) + (", ids binary" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        encoder, rows = Encoder.of(path, end_id, remembered), []
        number = TaskContext.get().partitionId() << 40
        doc_type = None

        def emit(window):
            nonlocal number
            offset = 0
            for doc, start, ids, total in window:
                data = ids.astype("<u4").tobytes()
                row = (doc, start, len(ids), zlib.crc32(data), total, number, offset)
                rows.append((*row, data) if with_ids else row)
                offset += len(ids)
            number += 1

        def ready():
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            types = [doc_type, *[pa.int64()] * 6, pa.binary()]
            out = [pa.array(c, t) for c, t in zip(columns, types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        packer = Packer(emit, length)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_type = batch.schema.field(0).type
            for part in steps(batch):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(utf8(part.column(1)))):
                    packer.add(doc, ids)
            yield ready()
        if doc_type is not None:
            packer.flush()
            yield ready()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
