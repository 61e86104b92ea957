"""Spelling variants: words of a corpus that differ by one character, grouped under their most frequent form.

Words are counted in Spark. Two words one edit apart share the first half of the shorter one, or its last
half, so words meet under these halves and never by any other way; a half that many words share is cut into
chunks, and every pair of chunks becomes a piece of its own. A piece is a sorted list, scanned by its words.
The scan keeps a banded row of the edit matrix for a prefix and reuses it for all words of the list that begin
with it, as the longest common prefixes of neighbours tell; ranges whose common prefix exceeds one edit are
skipped. Many words scan at once, one character further at a time. Words from the last half are read
backwards, so that the same scan fits. Pieces hand on, for each word, how many near words it has and the most frequent of them.

A form has at least twice the occurrences of its word, so chains of forms are short and free of cycles;
roots are found by pointer doubling.

Occurrences may be changed beforehand: of every run whose checksum with its document's id is divisible by
``DROP_EVERY``, one character is left out. A null id counts as an empty text there.

Defined results: null and empty texts have no words. Repeated rows count each on their own. Ties between near
words go to the smallest in code-point order. Words of any length are compared whole. An empty table gives
an empty result. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm.common import runs, ship, staged

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2  # as frequent as its word, at least, is a form
CHUNK = 2**17  # characters of a list
QUERIES = 2048  # words that scan at a time


def count_words(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, drop_every=DROP_EVERY):
    """(word, n): the words of whole texts that are long and frequent enough."""
    # A shorter run gives no word of this length.
    found = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("_run"))
    word = F.col("_run")
    rows = rows.withColumn("_run", F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word))
    if drop_every:
        hashed = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
        at = (hashed % F.char_length("_run")).cast("int")
        cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
        word = F.when(hashed % drop_every == 0, cut).otherwise(word)
    words = rows.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _matrix(words, width):
    """Words of up to ``width`` characters as rows of code points, filled up with zeros."""
    text = "".join([word.ljust(width, "\0") for word in words])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def scan(letters, lists, half, block=QUERIES):
    """Pairs (i, j) of words one edit apart in sorted lists, where i has the shorter length and j that or one more.

    ``letters`` has the words in rows, the longer length wide; ``lists`` numbers each word's list, in order.
    The words of a list share their first ``half`` characters. Rows of the edit matrix are kept for a block of
    words at a time, one for each word and each prefix of the list that is still within one edit.
    """
    size, width = letters.shape
    least = width - 1
    shared = np.full(size, -1)  # with the word before
    differs = letters[1:] != letters[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width)
    shared[1:] = np.where(lists[1:] == lists[:-1], common, -1)
    # Where the ranges of words with a common prefix begin, by its length, and where they go on with one more character.
    ranges = [np.flatnonzero(shared < depth) for depth in range(half, width + 1)]
    further = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(ranges, ranges[1:])]
    padded = np.concatenate([letters[:, :least], np.full((size, 2), 2**32 - 1, np.uint32)], 1)
    found = [np.zeros((2, 0), np.int64)]
    shorter = np.flatnonzero(letters[:, least] == 0)
    for at in range(0, len(shorter), block):
        word = shorter[at : at + block]
        place = np.searchsorted(ranges[0], word, "right") - 1
        # A word's own prefix: no edit on the diagonal, one beside it.
        left, middle, right = (np.full(len(word), x, np.int8) for x in (1 if half else 2, 0, 1))
        for depth in range(half, width):
            begin, starts = further[depth - half], ranges[depth - half + 1]
            count = begin[place + 1] - begin[place]
            row = np.repeat(np.arange(len(word)), count)
            place = begin[place][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            c, word = letters[starts[place], depth], word[row]
            left, middle, right = left[row], middle[row], right[row]
            if depth == least:
                one = np.where(c == 0, middle, np.minimum(left + (c != padded[word, depth - 1]), middle + 1)) == 1
                found.append(np.stack([word[one], starts[place[one]]]))
                break
            left = np.minimum(left + (c != padded[word, depth - 1]), middle + 1)
            middle = np.minimum(np.minimum(middle + (c != padded[word, depth]), right + 1), left + 1)
            right = np.minimum(right + (c != padded[word, depth + 1]), middle + 1)
            # Ranges whose common prefix exceeds one edit are skipped.
            near = np.minimum(np.minimum(left, middle), right) < 2
            word, place, left, middle, right = (x[near] for x in (word, place, left, middle, right))
    return np.concatenate(found, 1)


def _scan_pieces(rows):
    """(word, near, form_n, form): for the words of each piece, near words counted and the most frequent one."""

    def scan_all(batches):
        for table, _ in runs(batches):
            kinds, leasts = (table.column(c).to_numpy() for c in ("kind", "least"))
            out = [[], [], [], []]
            for kind, least in sorted(set(zip(kinds.tolist(), leasts.tolist()))):
                part = table.filter(pa.array((kinds == kind) & (leasts == least)))
                _near_in(kind, least, *(part.column(c) for c in ("piece", "side", "word", "n")), out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                ["word", "near", "form_n", "form"],
            )

    return rows.mapInArrow(scan_all, "word string, near long, form_n long, form string")


def _near_in(kind, least, pieces, sides, words, counts, out):
    """Adds the near words of lists of one kind; words of two chunks (sides -1 and 1) are near across chunks only."""
    pieces, sides, counts, words = pieces.to_numpy(), sides.to_numpy(), counts.to_numpy(), words.to_pylist()
    letters = _matrix(words, least + 1)
    first, last = least // 2, least - least // 2
    a, b = scan(letters, pieces, first if kind == 0 else last)
    apart = (sides[a] == 0) | (sides[a] != sides[b])
    if kind == 1:  # words alike in both halves are met under the first one
        ends = np.array([len(word) for word in words])
        offset = np.arange(1, first + 1)
        apart &= (letters[a[:, None], (ends[a, None] - offset)] != letters[b[:, None], (ends[b, None] - offset)]).any(1)
    a, b = a[apart], b[apart]
    # Words of equal length find each other; a longer one is only found.
    longer = letters[b, least] != 0
    own, other = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    read = words if kind == 0 else [word[::-1] for word in words]
    best = {}
    for x, y, n in zip(own.tolist(), other.tolist(), counts[other].tolist()):
        known = best.get(x)
        if known is None:
            best[x] = [1, n, read[y]]
            continue
        known[0] += 1
        if n > known[1] or n == known[1] and read[y] < known[2]:
            known[1:] = n, read[y]
    for x, (near, n, form) in best.items():
        for column, value in zip(out, (read[x], near, n, form)):
            column.append(value)


def near_words(words):
    """(word, n_near, best_n, best): for every word with near words, their number and the most frequent."""
    length = F.char_length("word")
    met = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("least")).where("least > 0")
    first = F.floor(F.col("least") / 2).cast("int")
    met = met.select(
        "word", "n", "least",
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.substr("word", F.lit(1), first).alias("half"), F.col("word").alias("read")),
            F.struct(F.lit(1).alias("kind"), F.reverse(F.substr("word", F.char_length("word") - F.col("least") + first + 1)).alias("half"),
                     F.reverse("word").alias("read")),
        )).alias("_met"),
    ).select("n", "least", "_met.*")
    key = ["kind", "least", "half"]
    # A pair has at least one word of the shorter length.
    shorter = F.max((F.char_length("read") == F.col("least")).cast("int"))
    sizes = met.groupBy(*key).agg(F.count("*").alias("_size"), shorter.alias("_some")).where("_size > 1 AND _some = 1")
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("_size") * F.col("least") / CHUNK).alias("_chunks"))
    rows = met.join(sizes, [F.col(k) == F.col(f"_{k}") for k in key])
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("read"), F.col("_chunks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    rows = rows.select(
        F.xxhash64(*key, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("piece"),
        "kind", "least", F.signum(F.col("_own") - F.col("_other")).cast("int").alias("side"), F.col("read").alias("word"), "n",
    )
    rows = rows.repartition("piece").sortWithinPartitions("piece", "kind", "least", "word")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    found = _scan_pieces(rows).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best"))
    return found.select("word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.form").alias("best"))


def roots(forms):
    """(word, root) of ``forms`` (word, form): where following forms ends. Each round doubles the steps taken."""
    known = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not known.where("moved").isEmpty():
        further = known.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        known = known.join(further, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")
        )
        known = staged(known, "roots")
    return known.select("word", "root")


def group_variants(words, times=TIMES):
    """One row per word of ``words`` (word, n): its form, its root, its near words counted."""
    ship(words.sparkSession)
    words = staged(words.select("word", "n"), "words")
    near = near_words(words).withColumnRenamed("word", "_word")
    is_form = F.col("best_n") >= times * F.col("n")
    joined = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    joined = staged(joined, "variants")
    ends = roots(joined.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    return joined.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs):
    """The words of all documents, grouped into spelling variants."""
    return group_variants(count_words(docs))
