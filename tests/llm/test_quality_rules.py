import re
from collections import Counter

import numpy as np
from conftest import SMALL

from tallyframe.llm import quality_rules
from tallyframe.llm.quality_rules import judge, keep_good, learn, learn_rules, quality_table, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 8)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(repeated)


def test_statistics_equal_plain_python(spark):
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert text_statistics(row.text.encode())[:5] == plain(row.text)
    assert text_statistics(None) == text_statistics(b"") == (0,) * len(quality_rules.NAMES)


def test_odd_rows_and_no_labels(odd, labels):
    rows = quality_table(odd, labels((4, None, None, "t"), (None, 0, 0, "t"))).collect()
    assert len(rows) == 13
    for row in rows:
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert row.kept == (not row.base_failed)


def test_empty_table(odd, labels):
    assert quality_table(odd.limit(0), labels()).count() == 0
    assert keep_good(odd.limit(0), labels()).columns == odd.columns


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(1)
    table = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (table["a"] > 0.8) | ((table["b"] < 0.2) & (table["a"] < 0.3))
    rules = learn(table, bad, rng.random(3000) < 2 / 3)
    rejected = np.zeros(3000, bool)
    for rule in rules:
        held = np.ones(3000, bool)
        for condition in rule:
            held &= condition.holds(table)
        rejected |= held
    assert (rejected == bad).mean() > 0.98
    assert learn(table, np.zeros(3000, bool), rng.random(3000) < 0.5) == []


def test_held_out_accuracy_and_kept_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = learn_rules(docs, labels.where("doc_id % 2 = 0"))
    rows = judge(docs, rules, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.97 * len(rows)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality_table(docs, labels).where("kept").count()
