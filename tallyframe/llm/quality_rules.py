"""Quality rules as a learned decision list.

Fixed base limits fail a text outright. For the rest, sequential covering learns an ordered list of
rules from labelled statistics: each rule is a conjunction of thresholds, grown condition by condition
for information gain on two thirds of the sample, pruned on the other third, and kept only if it is
precise there. The list becomes a chain of Spark conditional expressions.

Defined results: a null or empty text has no words and fails the base limits. A document without a
label is judged like any other. A document with several labels counts as good only if all say so;
null labels are ignored. Without usable labels the list is empty and the base limits alone decide.
Repeated rows are judged alike, each on its own. Columns of the input other than id and text are ignored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm.common import characters, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

STATISTICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct_words long, n_upper long, n_digits long, n_marks long"
)
NAMES = [part.split()[0] for part in STATISTICS.split(", ")]

# Shares the rules are learned on: (name, numerator, denominator); lengths as they are.
FEATURES = (
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("repeated_lines", "n_dup_lines", "n_lines"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("distinct_words", "n_distinct_words", "n_words"),
    ("upper_case", "n_upper", "word_chars"),
    ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "word_chars"),
)

WINDOW = 8  # words that have to be found again to count as repeated
SAMPLE_ROWS = 20_000  # labelled documents the rules are learned from, lowest hashes first
MIN_PRECISION = 0.95  # of a rejecting rule on the pruning rows
MIN_ROWS = 5  # that a rule has to reject on the growing rows
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48  # thresholds tried for a statistic


def _repeated(words):
    """Words inside windows of 8 found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for step in (1, 2, 4):
        mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15) + mixed[step:]
        mixed = mixed ^ (mixed >> np.uint64(29))
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW))))
    found = Counter(windows)
    marked = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((found[w] > 1 for w in windows), bool, n)
    np.add.at(marked, np.flatnonzero(at), 1)
    np.add.at(marked, np.flatnonzero(at) + WINDOW, -1)
    return int((np.cumsum(marked[:-1]) > 0).sum())


def text_statistics(text):
    """The statistics of one text, in the order of ``STATISTICS``."""
    if not text:
        return (0,) * len(NAMES)
    words = text.split()
    lines = text.split(b"\n")
    repeated_lines = 0
    if len(set(lines)) < len(lines):
        filled = [line for line in lines if line.strip(SPACES)]
        repeated_lines = len(filled) - len(set(filled))
    size = len(text)
    count = lambda drop: size - len(text.translate(None, drop))
    return (
        len(words), characters(text) - count(SPACES), count(SYMBOLS), repeated_lines, _repeated(words),
        len(lines), len(set(words)), count(UPPER), count(DIGITS), count(MARKS),
    )


def statistics(text):
    """A struct column of the statistics of a text column."""

    @arrow_udf(STATISTICS)
    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([text_statistics(t) for t in utf8(texts)], np.int64).reshape(-1, len(NAMES))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(NAMES))], NAMES)

    # Measured once per row, however many expressions use it.
    return measure.asNondeterministic()(text)


def base_failed(stats="s"):
    s = lambda name: F.col(f"{stats}.{name}")
    return (s("n_words") < 20) | (100 * s("n_repeat_words") > 30 * s("n_words"))


def features(stats="s"):
    """Named double columns the rules test."""
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    return {
        name: s(top) if bottom is None else s(top) / F.greatest(s(bottom), F.lit(1.0))
        for name, top, bottom in FEATURES
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table):
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, columns):
        value = columns[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _covered(rule, table, rows):
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _grow(table, bad, rows):
    """Adds the condition with the highest information gain until the rule covers bad rows only."""
    rule, covered = [], rows
    while len(rule) < MAX_CONDITIONS and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for feature in table:
            values = table[feature][covered]
            is_bad = bad[covered]
            order = np.argsort(values, kind="stable")
            values, is_bad = values[order], np.cumsum(is_bad[order])
            ends = np.flatnonzero(values[1:] > values[:-1])
            if len(ends) > CUTS:
                ends = ends[np.linspace(0, len(ends) - 1, CUTS).round().astype(int)]
            for end in ends:
                threshold = (values[end] + values[end + 1]) / 2
                low_bad, low = is_bad[end], end + 1
                for above, p, total in ((False, low_bad, low), (True, p0 - low_bad, p0 + n0 - low)):
                    if p < MIN_ROWS:
                        continue
                    gained = p * (np.log2(p / total) - np.log2(p0 / (p0 + n0)))
                    if gained > gain:
                        best, gain = Condition(feature, above, float(threshold)), gained
        if best is None:
            break
        rule.append(best)
        covered = covered & best.holds(table)
    return rule


def _prune(rule, table, bad, rows):
    """The leading conditions that separate best on the pruning rows."""

    def worth(kept):
        covered = _covered(kept, table, rows)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    lengths = range(1, len(rule) + 1)
    return rule[: max(lengths, key=lambda k: (worth(rule[:k]), -k))] if rule else rule


def learn(table, bad, grow):
    """The ordered rejecting rules; ``grow`` marks growing rows, the others prune."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & grow & bad).sum() >= MIN_ROWS:
        rule = _prune(_grow(table, bad, left & grow), table, bad, left & ~grow)
        if not rule:
            break
        seen = _covered(rule, table, left & ~grow)
        if not seen.any() or (seen & bad).sum() < MIN_PRECISION * seen.sum():
            break
        rules.append(rule)
        left = left & ~_covered(rule, table, np.ones(len(bad), bool))
    return rules


def verdict(rules, columns):
    """Whether the list rejects a row: its first rule that holds decides, else the row is good."""
    chain = None
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(columns)
        chain = F.when(holds, F.lit(True)) if chain is None else chain.when(holds, F.lit(True))
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def learn_rules(docs, labels, sample_rows=SAMPLE_ROWS):
    """Learns the list from at most ``sample_rows`` labelled documents, chosen by the hash of their id."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    rows = (
        docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
        .select("_id", "_quality", statistics(F.col("_text")).alias("s"))
    )
    rows = rows.where(~base_failed()).select(
        "_quality",
        (F.pmod(F.xxhash64(F.lit("grow"), "_id"), F.lit(3)) < 2).alias("_grow"),
        *[column.alias(name) for name, column in features().items()],
    )
    # Repeated rows of a document could exceed the sample's bound.
    rows = rows.limit(2 * sample_rows).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    table = {name: rows[name].to_numpy(np.float64) for name, _, _ in FEATURES}
    return learn(table, (rows["_quality"] <= 0).to_numpy(bool), rows["_grow"].to_numpy(bool))


def judge(docs, rules, keep=()):
    """Statistics, base limits and verdict for every row, beside the columns named in ``keep``."""
    measured = docs.select(*keep, statistics(F.col("text")).alias("s"))
    failed = base_failed()
    return measured.select(
        *keep, *[F.col(f"s.{name}").alias(name) for name in NAMES],
        failed.alias("base_failed"), (~failed & ~verdict(rules, features())).alias("kept"),
    )


def quality_table(docs, labels):
    """One row per document: its statistics, ``base_failed`` and ``kept``."""
    return judge(docs, learn_rules(docs, labels), ["doc_id"])


def keep_good(docs, labels):
    """The documents the base limits and the learned rules keep, with all their columns."""
    rules = learn_rules(docs, labels)
    # The row travels as one struct beside its statistics, so that no name of it can clash.
    packed = docs.select(F.struct("*").alias("_row"), statistics(F.col("text")).alias("s"))
    return packed.where(~base_failed() & ~verdict(rules, features())).select("_row.*")
