"""Language identification by a byte convolutional network.

Bytes are embedded, filtered by convolutions of several widths, max-pooled over a window of fixed length
and classified by a softmax layer. The network is trained in numpy on windows of labelled texts; every
text is then read whole, cut into windows, and its windows' log probabilities are averaged.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any learned
language every text is ``und``. A document whose id is null is not held out and never learned from.
Documents whose language is null are not learned from but predicted like all others. Repeated rows are
predicted alike. An empty table gives an empty result. Other columns of the input are ignored.

The training sample is bounded: ``DOCS_PER_LANGUAGE`` documents of each language, chosen by the hash of
their id, at most ``SAMPLE_DOCS`` in all, and ``DOC_WINDOWS`` windows spread over each text.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm.common import fold, utf8

FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # per width
EMBEDDING = 6
BATCH_WINDOWS = 128

DOCS_PER_LANGUAGE = 500
SAMPLE_DOCS = 20_000
DOC_WINDOWS = 4
EPOCHS = 6
RATE = 0.01

ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text):
    if ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def windows_of(text):
    """A text's bytes as rows of fixed length; the last one is padded with zeros."""
    rows = max(1, -(-len(text) // WINDOW_BYTES))
    out = np.zeros(rows * WINDOW_BYTES, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WINDOW_BYTES)


class Network:
    """Parameters and passes; all filters are as wide as the widest, zero where their width ends."""

    def __init__(self, languages, seed=0):
        rng = np.random.default_rng(seed)
        widest, filters = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((widest, EMBEDDING, filters), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(widest * EMBEDDING, filters)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "embedding": rng.standard_normal((256, EMBEDDING)).astype(np.float32),
            "filters": scale(widest * EMBEDDING, filters) * self.mask,
            "filter_bias": np.zeros(filters, np.float32),
            "dense": scale(filters, len(languages)),
            "dense_bias": np.zeros(len(languages), np.float32),
        }

    def _columns(self, windows):
        """Each position's next bytes, embedded: (windows * positions, widest * embedding)."""
        n, widest = len(windows), max(WIDTHS)
        embedded = np.zeros((n, WINDOW_BYTES + widest - 1, EMBEDDING), np.float32)
        embedded[:, :WINDOW_BYTES] = self.p["embedding"][windows]
        a, b, c = embedded.strides
        view = np.lib.stride_tricks.as_strided(
            embedded, (n, WINDOW_BYTES, widest * EMBEDDING), (a, b, c), writeable=False
        )
        return view.reshape(n * WINDOW_BYTES, widest * EMBEDDING)

    def log_probabilities(self, windows):
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for start in range(0, len(windows), BATCH_WINDOWS):
            part = windows[start : start + BATCH_WINDOWS]
            maps = (self._columns(part) @ self.p["filters"]).reshape(len(part), WINDOW_BYTES, -1)
            pooled = np.maximum(maps.max(1) + self.p["filter_bias"], 0)
            logits = pooled @ self.p["dense"] + self.p["dense_bias"]
            logits -= logits.max(1, keepdims=True)
            out[start : start + len(part)] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out

    def gradients(self, windows, wanted):
        n, p = len(windows), self.p
        columns = self._columns(windows)
        maps = (columns @ p["filters"]).reshape(n, WINDOW_BYTES, -1)
        best = maps.argmax(1)
        raw = np.take_along_axis(maps, best[:, None], 1)[:, 0] + p["filter_bias"]
        pooled = np.maximum(raw, 0)
        logits = pooled @ p["dense"] + p["dense_bias"]
        probabilities = np.exp(logits - logits.max(1, keepdims=True))
        probabilities /= probabilities.sum(1, keepdims=True)
        slope = probabilities
        slope[np.arange(n), wanted] -= 1
        slope /= n
        back = (slope @ p["dense"].T) * (raw > 0)
        # Only the position that won the pooling passes a filter's gradient on.
        won = columns.reshape(n, WINDOW_BYTES, -1)[np.arange(n)[:, None], best]
        filters = np.einsum("nf,nfk->kf", back, won) * self.mask
        to_columns = back[:, :, None] * p["filters"].T[None]
        embedding = np.zeros_like(p["embedding"])
        padded = np.zeros((n, WINDOW_BYTES + max(WIDTHS) - 1), np.int64)
        padded[:, :WINDOW_BYTES] = windows
        for k in range(max(WIDTHS)):
            at = padded[np.arange(n)[:, None], best + k]
            inside = (best + k < WINDOW_BYTES)[:, :, None]
            np.add.at(embedding, at, to_columns[:, :, k * EMBEDDING : (k + 1) * EMBEDDING] * inside)
        return {
            "embedding": embedding, "filters": filters, "filter_bias": back.sum(0),
            "dense": pooled.T @ slope, "dense_bias": slope.sum(0),
        }

    def train(self, windows, wanted, epochs=EPOCHS, rate=RATE, seed=0):
        """Adam over shuffled batches, the rate falling to zero."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        batches = -(-len(windows) // BATCH_WINDOWS)
        for step in range(epochs * batches):
            if step % batches == 0:
                order = rng.permutation(len(windows))
            rows = order[(step % batches) * BATCH_WINDOWS :][:BATCH_WINDOWS]
            now = rate * (1 - step / (epochs * batches))
            for k, g in self.gradients(windows[rows], wanted[rows]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                m, v = first[k] / (1 - 0.9 ** (step + 1)), second[k] / (1 - 0.999 ** (step + 1))
                self.p[k] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self


def training_windows(docs):
    """(language, windows): some windows, evenly spread over the text, of every sampled document."""

    @arrow_udf("binary")
    def sampled(texts: pa.Array) -> pa.Array:
        out = []
        for text in utf8(texts):
            rows = windows_of(text or b"")
            at = np.unique(np.linspace(0, len(rows) - 1, DOC_WINDOWS).round().astype(int))
            out.append(rows[at].tobytes())
        return pa.array(out, pa.binary())

    learned = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    learned = learned.where(F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = learned.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DOCS_PER_LANGUAGE)
    ids = ids.orderBy("_n", "_lang", "_id").limit(SAMPLE_DOCS).select("_id", "_lang").distinct()
    chosen = docs.select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_l"), F.col("text").alias("_text"))
    chosen = chosen.join(F.broadcast(ids), (F.col("_doc") == F.col("_id")) & (F.col("_l") == F.col("_lang")))
    return chosen.select("_id", "_lang", sampled(F.col("_text")).alias("_windows"))


def learn(docs, seed=0):
    """The trained network, or None if nothing can be learned from."""
    rows = training_windows(docs).limit(2 * SAMPLE_DOCS).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r._id, r._lang, bytes(r._windows)))
    languages = sorted({r._lang for r in rows})
    parts = [np.frombuffer(bytes(r._windows), np.uint8).reshape(-1, WINDOW_BYTES) for r in rows]
    wanted = np.repeat([languages.index(r._lang) for r in rows], [len(p) for p in parts])
    windows = np.concatenate(parts)
    # A third of the windows is shortened, as short texts are at prediction.
    rng = np.random.default_rng(seed)
    lengths = np.where(rng.random(len(windows)) < 1 / 3, rng.integers(16, WINDOW_BYTES, len(windows)), WINDOW_BYTES)
    windows = np.where(np.arange(WINDOW_BYTES) < lengths[:, None], windows, 0).astype(np.uint8)
    return Network(languages, seed).train(windows, wanted, seed=seed)


def predict(text, network):
    """A struct column (lang_pred, score) for a text column."""
    names = ["lang_pred", "score"]

    @arrow_udf("lang_pred string, score double")
    def classify(texts: pa.Array) -> pa.Array:
        answers = []
        for text in utf8(texts):
            if network is None or text is None or not has_letter(text):
                answers.append((UNDETERMINED, 0.0))
                continue
            windows = windows_of(text)
            logs = network.log_probabilities(windows).astype(np.float64)
            # Windows count by how much text they hold.
            weights = np.full(len(windows), float(WINDOW_BYTES))
            weights[-1] = len(text) - WINDOW_BYTES * (len(windows) - 1)
            mean = weights @ logs / weights.sum()
            odds = np.exp(mean - mean.max())
            best = int(odds.argmax())
            answers.append((network.languages[best], float(odds[best] / odds.sum())))
        columns = list(zip(*answers)) if answers else [[], []]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], names)

    return classify.asNondeterministic()(text)


def identify(docs):
    """One row per document: whether it was held out, its predicted language and the score."""
    network = learn(docs)
    out = docs.select("doc_id", predict(F.col("text"), network).alias("_p"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "_p.lang_pred", "_p.score")
