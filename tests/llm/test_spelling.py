import random
import re
import zlib

import numpy as np
import pytest

from tallyframe.functions.local import local_table
from tallyframe.llm import spelling
from tallyframe.llm.spelling import group_variants, scan, spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    cut = [b[:k] + b[k + 1 :] for k in range(len(b))]
    return a in cut if len(a) < len(b) else any(a[:k] + a[k + 1 :] == c for k, c in enumerate(cut))


def grouped(counts):
    out = {}
    for word, n in counts.items():
        close = sorted((-m, other) for other, m in counts.items() if near(word, other))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[word] = [form, None, n, len(close), counts[form] if form else None]
    for word, row in out.items():
        row[1] = word
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return sorted((word, *row) for word, row in out.items())


def counted(docs):
    counts = {}
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def words_table(spark, counts):
    return local_table(spark, [(w, n, "x") for w, n in counts.items()], "word string, n long, form string").repartition(3)


@pytest.mark.parametrize("chunk", [2**17, 60])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    draw = random.Random(chunk)
    letters = "abé\u00ff"
    words = {"".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 5, 6, 6, 7, 8]))) for _ in range(700)}
    counts = {w: draw.choice([1, 2, 3, 5, 8, 20, 400]) for w in words}
    assert found(group_variants(words_table(spark, counts))) == grouped(counts)


def test_scan_of_lists():
    draw = random.Random(1)
    for _ in range(200):
        least = draw.randint(1, 6)
        half = draw.choice([0, least // 2])
        words = {draw.choice(["aaa", "bab", "cca"])[:half] for _ in range(60)}
        words = sorted({w + "".join(draw.choice("abc") for _ in range(draw.choice([least, least + 1]) - half)) for w in words for _ in range(30)})
        lists = np.array([sum(ord(c) * 7**k for k, c in enumerate(w[:half])) for w in words])
        pairs = scan(spelling._matrix(words, least + 1), lists, half, block=draw.choice([3, 1000]))
        expected = [
            (i, j) for i, a in enumerate(words) for j, b in enumerate(words)
            if len(a) == least and a[:half] == b[:half] and near(a, b)
        ]
        assert sorted(zip(*pairs.tolist())) == expected


def test_long_chain_and_hot_form(spark):
    chain = {"abcdefgh"[:k] + "x" * (8 - k): 3 * 2**k for k in range(9)}
    hot = {"middle" + c: 3 for c in "abcdefghijklmnopqrstuvwxyz"} | {"middle": 100}
    counts = chain | hot
    got = found(group_variants(words_table(spark, counts)))
    assert got == grouped(counts)
    assert dict((r[0], r[2]) for r in got)["xxxxxxxx"] == "abcdefgh"


def test_documents(spark, documents):
    draw = random.Random(3)
    vocabulary = ["answer", "answers", "ANSWER", "Ärger", "ärger", "letter", "lettér", "lettre", "colour", "color", "no", "x" * 3000]
    docs = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", ".", "1", "_"]) for _ in range(60))) for i in range(120)]
    docs += [(None, "answer answer"), (3, None), (4, ""), (5, "answer"), (5, "answer")]
    got, expected = found(spelling_variants(documents(*docs))), grouped(counted(docs))
    assert got == expected and any(len(r[0]) == 2999 for r in got) is any(len(r[0]) == 2999 for r in expected)


def test_odd_documents(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spelling_variants(odd)) == grouped(counted(rows))
    assert spelling_variants(odd.limit(0)).count() == 0


def test_given_table(spark):
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = local_table(spark, rows, "doc_id long, text string")
    assert found(spelling_variants(docs)) == grouped(counted(rows))
