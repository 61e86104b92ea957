import hashlib
import random

import pytest
from conftest import SMALL

from tallyframe.llm import suffix_dedup
from tallyframe.llm.suffix_dedup import remove_repeats


def plain(rows):
    """The result for rows (id, text); ids may be null or repeated."""
    seen, out = {}, []
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            if i is not None:
                w = data[p : p + 50]
                seen[w] = min(seen.get(w, i), i)
    for i, text in rows:
        data = (text or "").encode()
        mark = [False] * len(data)
        for p in range(len(data) - 49):
            if i is not None and seen[data[p : p + 50]] < i:
                mark[p : p + 50] = [True] * 50
        rest = bytes(b for b, m in zip(data, mark) if not m)
        spans = sum(m and not before for before, m in zip([False, *mark], mark))
        out.append((i, len(data), sum(mark), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(remove_repeats(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_of_every_length(documents, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 300)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    passages += ["ab" * 40, "z" * 90]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            text = rng.choice(passages)
            cut = rng.randint(0, 25)
            parts.append(rng.choice([text, text[cut:], text[: len(text) - cut]]))
            parts.append("".join(rng.choice("efgh") for _ in range(rng.choice([0, 1, 7, 40, 100]))))
        rows.append((rng.randrange(1000) * 100 + i, "".join(parts)))
    assert found(remove_repeats(documents(*rows))) == plain(rows)


def test_lengths_around_the_limit(documents):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij") for _ in range(200))
    rows = [(100 + i, base[i : i + 47 + i % 7]) for i in range(0, 140, 3)] + [(5, base), (6, base[:49]), (7, base[-50:])]
    assert found(remove_repeats(documents(*rows))) == plain(rows)


def test_odd_rows(odd, documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(remove_repeats(odd)) == plain(rows)
    assert remove_repeats(odd.limit(0)).count() == 0
    long = "0123456789" * 4 + "abcdefghij" * 4
    rows = [(3, long + "x"), (3, long + "y"), (3, long + "x"), (4, "y" + long), (2, "q" + long[:60]), (None, long)]
    assert found(remove_repeats(documents(*rows))) == plain(rows)
