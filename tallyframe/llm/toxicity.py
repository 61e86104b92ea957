"""Toxicity by class-conditional Kneser-Ney models.

Words, lower-cased and stripped of everything but letters, are sequences of bytes; a model predicts each
byte, and the end of the word, from the bytes before it in the word. The toxic and the ordinary model
discount their own highest-order counts; what they discount goes to lower orders that both share, built
from continuation counts of all labelled texts, so that expressions rare in one class are smoothed by
what is known of the language. A text is scored by the difference of the two log-likelihoods, normalised
by length: over the text, and over its most toxic words, which a long text would otherwise dilute. A
logistic curve fitted on labelled texts that the models have not seen turns these into a score.

Counts are taken from all labelled texts of the learning folds, a quarter of which is set aside for the
curve. The model that tasks receive has every counted sequence, however rare, and every context: it grows
with the distinct sequences of the learning texts, about 50 bytes in a worker for each. The curve is
fitted on at most ``CURVE_ROWS`` documents, those with the lowest hashes of each class, each weighted by
the inverse of its class's sampling rate: scores follow the true share of toxic texts at every size.

Defined results: a null or empty text, or one without a letter, has no evidence and gets the score of
the curve there. Without labels of both classes every score is 0. A document labelled repeatedly is toxic
if one label says so; null labels and null ids are not learned from. A row whose id is null is not held
out. Repeated rows are scored alike; an empty table gives an empty result. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm.common import fold, staged, utf8

FOLDS, HELD_OUT = 3, 1
ORDER = 6  # bytes of a sequence, the predicted one included
DISCOUNT = 0.75
THRESHOLD = 0.7
CURVE_ROWS = 8_000
STEP_BYTES = 1 << 20
HELD_KEYS = 1_000_000
TOP = 3  # words that count as the most toxic ones
UNSEEN = 255  # never a byte of UTF-8: stands for bytes not seen in a context

# Lower-case letters stay, upper-case ones become lower, bytes above 127 are parts of letters.
BYTE = np.zeros(256, np.uint8)
BYTE[97:123] = np.arange(97, 123)
BYTE[65:91] = np.arange(97, 123)
BYTE[128:] = np.arange(128, 256)


def events(texts):
    """(sequences, document of each, starts of words among them) for a list of UTF-8 texts or None.

    A sequence packs a byte below the bytes before it in its word; a word's end is a zero byte.
    """
    texts = [(t or b"").decode("utf-8", "replace").lower().encode() if t and not t.isascii() else t or b"" for t in texts]
    data = BYTE[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)].astype(np.uint64)
    n = len(data)
    keys, alive = data.copy(), np.ones(n, bool)
    for back in range(1, ORDER):
        before = np.zeros(n, np.uint64)
        before[back:] = data[:-back]
        alive &= before > 0
        keys |= np.where(alive, before, 0) << np.uint64(8 * back)
    letter = data > 0
    after = np.zeros(n, bool)
    after[1:] = letter[:-1]
    at = np.flatnonzero(letter | after)
    starts = np.flatnonzero((letter & ~after)[at])
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    return keys[at].view(np.int64), np.searchsorted(ends, at, "right"), starts


def _merged(parts):
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], starts) for i in (1, 2))


def _steps(texts):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > STEP_BYTES or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def counted(rows):
    """(key, toxic, ordinary): how often each sequence occurs in rows (text, toxic) of either class."""

    def count(batches):
        held = []
        size = 0
        schema = ["key", "toxic", "ordinary"]
        for batch in batches:
            texts, toxic = utf8(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in _steps(texts):
                keys, doc, _ = events(texts[a:b])
                if not len(keys):
                    continue
                bad = toxic[a:b][doc].astype(np.int64)
                held.append(_merged([(keys, bad, 1 - bad)]))
                size += len(held[-1][0])
                if size > HELD_KEYS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(held)], schema)

    found = rows.select("text", "toxic").mapInArrow(count, "key long, toxic long, ordinary long")
    return found.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared(grams):
    """(gram, p): shared probability of each suffix one byte shorter than the counted sequences.

    Every order counts in how many ways a sequence continues the next longer one.
    """
    mask = lambda size: (1 << (8 * size)) - 1
    levels, longer = [], grams.select("key")
    for size in range(ORDER - 1, 0, -1):
        level = longer.groupBy(F.col("key").bitwiseAND(F.lit(mask(size)).cast("long")).alias("gram")).agg(
            F.count("*").alias("n")
        )
        level = staged(level, "kneser-level")
        levels.append((size, level))
        longer = level.select(F.col("gram").alias("key"))
    below = None
    for size, level in reversed(levels):
        context = F.shiftright("gram", 8)
        sums = level.groupBy(context.alias("_context")).agg(F.sum("n").alias("_all"), F.count("*").alias("_kinds"))
        joined = level.join(sums, context == F.col("_context"))
        lower = F.lit(1 / 256)
        if below is not None:
            shorter = F.col("gram").bitwiseAND(F.lit(mask(size - 1)).cast("long"))
            joined = joined.join(below.withColumnsRenamed({"gram": "_shorter", "p": "_p"}), shorter == F.col("_shorter"))
            lower = F.col("_p")
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("_kinds") * lower) / F.col("_all")
        below = joined.select("gram", p.alias("p"))
    return below


def learn_model(rows):
    """All sequences, sorted, and the log-likelihood difference, toxic minus ordinary, each of them adds."""
    grams = staged(counted(rows), "kneser-counts")
    context = F.shiftright("key", 8)
    sums = grams.groupBy(context.alias("_context")).agg(
        *[F.sum(c).alias(f"_all_{c}") for c in ("toxic", "ordinary")],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"_kinds_{c}") for c in ("toxic", "ordinary")],
    )
    sums = staged(sums, "kneser-contexts")

    def left_over(c):
        # The share a class leaves to the lower orders: all of it where it has not seen the context.
        share = DISCOUNT * F.col(f"_kinds_{c}") / F.col(f"_all_{c}")
        return F.when(F.col(f"_all_{c}") > 0, share).otherwise(1.0)

    def log_p(c):
        own = F.when(F.col(c) > 0, (F.col(c) - DISCOUNT) / F.col(f"_all_{c}")).otherwise(0.0)
        return F.log(own + left_over(c) * F.col("p"))

    suffix = F.col("key").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1).cast("long"))
    known = grams.join(sums, context == F.col("_context")).join(_shared(grams), suffix == F.col("gram"))
    known = known.select("key", (log_p("toxic") - log_p("ordinary")).alias("gain"))
    # Bytes not seen after a context differ by what the classes leave over there.
    unseen = sums.select(
        (F.shiftleft("_context", 8) + UNSEEN).alias("key"),
        (F.log(left_over("toxic")) - F.log(left_over("ordinary"))).alias("gain"),
    )
    model = known.unionByName(unseen).select("key", F.col("gain").cast("float")).toArrow()
    keys, gains = (model.column(c).to_numpy() for c in ("key", "gain"))
    order = np.argsort(keys)
    return keys[order], gains[order]


class Table:
    """Hashed lookup of a model's entries, open addressing, on whole arrays."""

    FREE = -1

    def __init__(self, keys, gains):
        self.bits = max(4, (len(keys) * 3 // 2).bit_length())
        self.keys = np.full(1 << self.bits, self.FREE, np.int64)
        self.gains = np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.FREE
            _, one = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.keys[slot[taken]], self.gains[slot[taken]] = keys[left[taken]], gains[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys):
        """(gains, found)."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = there == keys
        gains = np.where(found, self.gains[slot], np.float32(0))
        left = np.flatnonzero(~found & (there != self.FREE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            gains[left[hit]], found[left[hit]] = self.gains[slot[hit]], True
            go = ~hit & (there != self.FREE)
            left, slot = left[go], slot[go]
        return gains, found

    def gain(self, keys):
        gains, found = self.find(keys)
        missing = np.flatnonzero(~found)
        if len(missing):
            gains[missing] = self.find(((keys[missing] >> 8) << 8) + UNSEEN)[0]
        return gains


EVIDENCE = ("mean", "top", "second", "high")


def evidence(texts, table):
    """Length-normalised log-likelihood differences: of the text per byte, and of its most toxic words."""
    out = np.zeros((len(texts), len(EVIDENCE)))
    for a, b in _steps(texts):
        keys, doc, starts = events(texts[a:b])
        if not len(keys):
            continue
        gains = table.gain(keys).astype(np.float64)
        total = np.bincount(doc, gains, b - a)
        out[a:b, 0] = total / np.maximum(np.bincount(doc, minlength=b - a), 1)
        words = np.add.reduceat(gains, starts)
        owner = doc[starts]
        order = np.lexsort((-words, owner))
        words, owner = words[order], owner[order]
        first = np.searchsorted(owner, np.arange(b - a))
        last = np.searchsorted(owner, np.arange(b - a), "right")
        sums = np.concatenate([[0.0], np.cumsum(words)])
        for column, reach in ((1, 1), (3, TOP)):
            stop = np.minimum(first + reach, last)
            filled = stop > first
            out[a:b, column][filled] = ((sums[stop] - sums[first]) / np.maximum(stop - first, 1))[filled]
        two = last - first > 1
        out[a:b, 2][two] = words[first[two] + 1]
    return out


def fit_curve(rows, toxic, weights=None, steps=50, ridge=1e-3):
    """Weights of a logistic curve over standardised evidence, by Newton's method; rows may be weighted."""
    weights = np.ones(len(rows)) if weights is None else weights / weights.mean()
    middle = np.average(rows, 0, weights)
    scale = np.sqrt(np.average((rows - middle) ** 2, 0, weights)) + 1e-9
    x = np.column_stack([(rows - middle) / scale, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (p - toxic)) + ridge * len(x) * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return middle, scale, w


class Scorer:
    def __init__(self, keys, gains, curve):
        self.keys, self.gains, self.curve, self.table = keys, gains, curve, None

    def __getstate__(self):
        return self.keys, self.gains, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def evidence(self, texts):
        if self.table is None:
            self.table = Table(self.keys, self.gains)
        return evidence(texts, self.table)

    def score(self, texts):
        middle, scale, w = self.curve
        x = (self.evidence(texts) - middle) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


def learn(docs, labels):
    """A broadcast scorer learned from the labelled documents outside the held-out fold, or None."""
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").where(fold("_doc", FOLDS) != HELD_OUT)
    part = F.pmod(F.xxhash64(F.lit("curve"), "_id"), F.lit(4))
    models, curve = marked.where(part > 0), marked.where(part == 0)
    # Labels grow with the documents: they are joined by a shuffle at every size, never broadcast.
    rows = texts.join(models.hint("merge"), F.col("_doc") == F.col("_id")).select("text", "toxic")
    keys, gains = learn_model(rows)
    sizes = dict(curve.groupBy("toxic").count().collect())
    most = CURVE_ROWS // 2
    parts = [curve.where(F.col("toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(most) for kind in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    sampled = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "toxic", "text")
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(keys, gains, None))

    @arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array(list(scorer.value.evidence(utf8(texts))), pa.list_(pa.float64()))

    # Repeated ids may give more rows than were chosen; those that stay are drawn at one rate for both classes.
    drawn = F.xxhash64("_id", "text", F.monotonically_increasing_id()).alias("_drawn")
    measured = sampled.select("_id", "toxic", drawn, measure(F.col("text")).alias("e"))
    rows = measured.orderBy("_drawn").limit(2 * CURVE_ROWS).collect()
    rows.sort(key=lambda r: (r._id, r.e))
    toxic = np.array([r.toxic for r in rows], np.float64)
    if not 0 < toxic.sum() < len(toxic):
        return None
    # A class is sampled at the rate of its chosen labels; every row stands for as many as that leaves out.
    weights = np.array([max(sizes[r.toxic] / most, 1.0) for r in rows])
    fitted = fit_curve(np.array([r.e for r in rows]), toxic, weights)
    return docs.sparkSession.sparkContext.broadcast(Scorer(keys, gains, fitted))


def predict(text, scorer):
    """A double column of scores for a text column."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if scorer is None:
            return pa.array(np.zeros(len(texts)))
        return pa.array(scorer.value.score(utf8(texts)))

    return score.asNondeterministic()(text)


def score_documents(docs, labels):
    """One row per document: whether it was held out, its score, and whether that means toxic."""
    scorer = learn(docs, labels)
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), predict(F.col("text"), scorer).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
