"""Vector code compression: a code per part of a vector, with codebooks learned by rounds of nearest entries.

Components become whole numbers and vectors are cut into equal parts. Each part position has a codebook,
improved in rounds: every part is assigned to its nearest entry, and each entry becomes the mean of its
parts, all in whole numbers, so that results do not depend on order. A round is one pass over the table:
tasks hand on a sum per entry and component, whatever the number of rows.

The nearest entry is found by memoised grid cells. A part's cell is its corner on a coarse grid; for the
cell's box every entry has a least and a greatest distance, and entries whose least distance exceeds
another's greatest are dominated: no point of the box is nearest to them. The entries left are remembered by
cell, and only they are evaluated exactly. The grid's step follows from the distances between entries.
At most ``CELLS`` cells are remembered by a task for each part; further cells are worked out each time.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; other vectors,
zero and empty ones too, are kept. Where lengths differ, shorter vectors count as filled up with zeros; where
a length cannot be cut equally, parts differ by one component. Whole numbers are kept within 2^26 either way
(components within 16,384), so that distances of up to 512 components a part are exact. Repeated rows are
vectors of their own. Null ids come last, and rows of equal ids are ordered by their components. With fewer
vectors than entries there are fewer entries. Ties go to the lower entry. An empty table gives an empty
result. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm.common import ship, staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 2**26
CELLS = 50_000
BLOCK = 4096  # cells or parts worked on at a time


def bounds(dims, parts):
    """Where the parts begin and end."""
    return [i * dims // parts for i in range(parts + 1)]


def grid_step(book):
    """The binary logarithm of a cell's side: half the usual distance of entries along a diagonal."""
    if len(book) < 2 or not book.shape[1]:
        return 0
    apart = np.sqrt(((book[:, None].astype(float) - book[None]) ** 2).sum(2))
    usual = np.median(apart[apart > 0]) if (apart > 0).any() else 1.0
    return max(0, int(np.log2(max(1.0, usual / (2 * np.sqrt(book.shape[1]))))))


class Assigner:
    """Nearest entries of one codebook, with the entries worth a look remembered by cell."""

    def __init__(self, book, cells=CELLS):
        self.book, self.step, self.cells, self.known = book, grid_step(book), cells, {}
        self.evaluated = 0  # exact distances, for tests and tuning

    def undominated(self, cells):
        """For each cell, which entries can be nearest to a point of its box."""
        low = (cells.astype(np.int64) << self.step)[:, None]
        high = low + (1 << self.step) - 1
        least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        most = np.maximum(np.abs(low - self.book), np.abs(high - self.book))
        least, most = (least * least).sum(2), (most * most).sum(2)
        return least <= most.min(1, keepdims=True)

    def _choices(self, points):
        """For each point the entries of its cell, as rows of truth values."""
        cells = np.ascontiguousarray((points >> self.step).astype(np.int32))
        if not cells.shape[1]:
            return np.ones((len(points), len(self.book)), bool)
        names = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1])))[:, 0]
        names, first, place = np.unique(names, return_index=True, return_inverse=True)
        keys = [name.tobytes() for name in names]
        found = [self.known.get(key) for key in keys]
        missing = [i for i, choice in enumerate(found) if choice is None]
        for start in range(0, len(missing), BLOCK):
            block = missing[start : start + BLOCK]
            for i, choice in zip(block, self.undominated(cells[first[block]])):
                found[i] = choice.tobytes()
                if len(self.known) < self.cells:
                    self.known[keys[i]] = found[i]
        choices = np.frombuffer(b"".join(found), bool).reshape(len(found), len(self.book))
        return choices[place.reshape(-1)]

    def __call__(self, points):
        """(entry, squared distance) of each point; ties go to the lower entry."""
        entries, distances = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for start in range(0, len(points), BLOCK):
            block = points[start : start + BLOCK]
            row, entry = np.nonzero(self._choices(block))
            self.evaluated += len(row)
            away = block[row] - self.book[entry]
            away = (away * away).sum(1)
            begin = np.searchsorted(row, np.arange(len(block)))
            least = np.minimum.reduceat(away, begin)
            hit = np.flatnonzero(away == least[row])
            hit = hit[np.searchsorted(row[hit], np.arange(len(block)))]
            entries[start : start + BLOCK], distances[start : start + BLOCK] = entry[hit], least
        return entries, distances


def _points(column, dims):
    """A list column of whole numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def whole_numbers(embeddings, scale=SCALE):
    """(vec_id, label, numbers) of the usable vectors, filled up to one length."""
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    number = lambda x: F.greatest(
        F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))
    ).cast("int")
    rows = embeddings.where(usable).select("vec_id", "label", F.transform("embedding", number).alias("numbers"))
    rows = staged(rows, "vector-numbers")
    low, dims = rows.agg(F.min(F.size("numbers")), F.max(F.size("numbers"))).first()
    if low != dims:
        filled = F.concat("numbers", F.array_repeat(F.lit(0), F.lit(dims) - F.size("numbers")))
        rows = rows.withColumn("numbers", filled)
    return rows, dims or 0


def _new_books(rows, dims, books):
    """One round: each entry becomes the mean of the parts nearest to it."""
    edges = bounds(dims, len(books))

    def add_up(batches):
        assigners = [Assigner(book) for book in books]
        sums = [np.zeros_like(book) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for batch in batches:
            points = _points(batch.column("numbers"), dims)
            for part, assigner in enumerate(assigners):
                own = points[:, edges[part] : edges[part + 1]]
                entries, _ = assigner(own)
                np.add.at(sums[part], entries, own)
                counts[part] += np.bincount(entries, minlength=len(books[part]))
        for part, (total, count) in enumerate(zip(sums, counts)):
            entry, place = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(total.size, part), entry, place, total.reshape(-1), count[entry])],
                ["part", "entry", "place", "total", "n"],
            )

    sums = rows.select("numbers").mapInArrow(add_up, "part long, entry long, place long, total long, n long")
    # At most a row per part, entry and component.
    means = sums.groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    books = [book.copy() for book in books]
    for r in means.collect():
        if r.n:
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def learn(rows, dims, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """Codebooks, one integer matrix (entries, components) per part position."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries).select("numbers").collect()
    start = np.array([r.numbers for r in first], np.int64).reshape(len(first), dims)
    edges = bounds(dims, parts)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    for _ in range(rounds if first else 0):
        books = _new_books(rows, dims, books)
    return books


def encode(rows, dims, books):
    """(vec_id, label, code, error): the entry of every part, and the squared distances summed."""
    edges = bounds(dims, len(books))
    label = rows.schema["label"].dataType.simpleString()
    vec_id = rows.schema["vec_id"].dataType.simpleString()

    def write(batches):
        assigners = [Assigner(book) for book in books]
        for batch in batches:
            points = _points(batch.column("numbers"), dims)
            codes, error = np.zeros((len(points), len(books)), np.uint8), np.zeros(len(points), np.int64)
            for part, assigner in enumerate(assigners):
                codes[:, part], away = assigner(points[:, edges[part] : edges[part + 1]])
                error += away
            digits, width = codes.tobytes().hex(), 2 * len(books)
            texts = [digits[i : i + width] for i in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(write, f"vec_id {vec_id}, label {label}, code string, error long")


def decode(code, books):
    """The whole numbers a code stands for."""
    return np.concatenate([book[entry] for book, entry in zip(books, bytes.fromhex(code))])


def digest(books):
    numbers = ",".join(str(x) for book in books for x in book.reshape(-1).tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(embeddings, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """One row per usable vector: its code, its error, the error of its label, and the codebooks' digest."""
    if not 1 <= entries <= 256:
        raise ValueError("A code holds 1 to 256 entries.")
    ship(embeddings.sparkSession)
    rows, dims = whole_numbers(embeddings, scale)
    books = learn(rows, dims, parts, entries, rounds)
    codes = staged(encode(rows, dims, books), "vector-codes")
    errors = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
