import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from tallyframe.functions.local import local_table
from tallyframe.llm import toxicity
from tallyframe.llm.toxicity import ORDER, Table, counted, events, fit_curve, learn_model, score_documents


def plain_events(text):
    """Each word's bytes, and its end, with up to five bytes before."""
    out = []
    word = b""
    for c in (text or "").lower().encode() + b" ":
        if 97 <= c <= 122 or c > 127:
            out.append((word[-(ORDER - 1) :], c))
            word += bytes([c])
        elif word:
            out.append((word[-(ORDER - 1) :], 0))
            word = b""
    return out


def packed(context, byte):
    return sum(c << (8 * (i + 1)) for i, c in enumerate(reversed(context))) + byte


TEXTS = ["Some words, IN two lines.\nÉté über x", "", None, "12 34", "aaaaaaaaaa bb", "don't"]


def test_events():
    keys, doc, starts = events([None if t is None else t.encode() for t in TEXTS])
    expected = [(packed(*e), i) for i, t in enumerate(TEXTS) for e in plain_events(t)]
    assert list(zip(keys.tolist(), doc.tolist())) == expected
    assert keys[starts].tolist() == [k for k, _ in expected if k < 256 and k > 0]


def test_gains_equal_plain_kneser_ney(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["abc", "abd", "xyz", "hello", "help"]) for _ in range(30)), 0) for _ in range(10)]
    rows += [(" ".join(rng.choice(["abc", "held", "helium", "mean"]) for _ in range(30)), 1) for _ in range(4)]
    grams = [Counter(), Counter()]
    for text, toxic in rows:
        grams[toxic].update(plain_events(text))
    every = {(b"\0" * (ORDER - 1 - len(c)) + c, b) for kind in grams for c, b in kind}
    levels, longer = {}, every
    for size in range(ORDER - 1, 0, -1):
        count = Counter((c[-(size - 1) :] if size > 1 else b"", b) for c, b in longer)
        levels[size] = count
        longer = set(count)

    def shared(context, byte, size):
        if size == 0:
            return 1 / 256
        context = context[-(size - 1) :] if size > 1 else b""
        inside = {b: n for (c, b), n in levels[size].items() if c == context}
        lower = shared(context[1:], byte, size - 1)
        return (inside[byte] - 0.75 + 0.75 * len(inside) * lower) / sum(inside.values())

    def log_p(kind, context, byte):
        inside = {b: n for (c, b), n in grams[kind].items() if c == context}
        full = b"\0" * (ORDER - 1 - len(context)) + context
        p = shared(full, byte, ORDER - 1)
        if not inside:
            return math.log(p)
        own = max(inside.get(byte, 0) - 0.75, 0) / sum(inside.values())
        return math.log(own + 0.75 * len(inside) / sum(inside.values()) * p)

    keys, gains = learn_model(local_table(spark, rows, "text string, toxic int"))
    found = dict(zip(keys.tolist(), gains.tolist()))
    for context, byte in set(grams[0]) | set(grams[1]):
        expected = log_p(1, context, byte) - log_p(0, context, byte)
        assert abs(found[packed(context, byte)] - expected) < 1e-4


def test_rare_sequences_of_large_models_are_kept(spark):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words = np.full((250_000, 9), 32, np.uint8)
    words[:, :8] = np.random.default_rng(3).choice(letters, (250_000, 8))
    texts = [words[i : i + 25_000].tobytes() for i in range(0, len(words), 25_000)]
    rows = [(t.decode(), int(i == 0)) for i, t in enumerate(texts)]
    keys, gains = learn_model(local_table(spark, rows, "text string, toxic int"))
    counted_keys = np.unique(events(texts)[0])
    assert len(counted_keys) > 1_000_000 and np.isin(counted_keys, keys).all()
    assert len(keys) == len(gains) and (np.diff(keys) > 0).all()


def test_counts(spark):
    rows = [("to be", 0), ("to be", 1), ("be", 1), (None, 0)]
    got = {r.key: (r.toxic, r.ordinary) for r in counted(local_table(spark, rows, "text string, toxic int")).collect()}
    expected = defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        for e in plain_events(text):
            expected[packed(*e)][1 - toxic] += 1
    assert got == {k: tuple(v) for k, v in expected.items()}


def test_lookup_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000))
    table = Table(keys, np.arange(len(keys), dtype=np.float32))
    gains, found = table.find(np.concatenate([keys, keys + (1 << 50)]))
    assert (gains[: len(keys)] == np.arange(len(keys))).all() and found[: len(keys)].all()
    assert not found[len(keys) :].any()
    assert not Table(keys[:0], np.zeros(0, np.float32)).find(keys)[1].any()


def test_planted_words_are_found_in_held_out_texts(documents, labels):
    rng = random.Random(7)
    syllables = ["ka", "lo", "mi", "tre", "ban", "su", "ver", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows, marks = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(10, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), "grizzled" + rng.choice(syllables))
        rows.append((i, " ".join(words)))
        if i % 3 or i % 7:
            marks.append((i, 1, int(toxic), "t"))
    rows += [(5000, None), (5001, ""), (5002, "12 ..."), (5003, "kalo"), (None, "kalo")]
    marks += [(None, 1, 1, "t"), (5003, 1, None, "t")]
    out = score_documents(documents(*rows), labels(*marks)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert all(r.predicted == 0 for r in out if r.doc_id is None or r.doc_id >= 5000)


def test_weights_stand_for_rows_left_out():
    rng = np.random.default_rng(5)
    toxic = np.repeat([0.0, 1.0], [900, 100])
    rows = rng.normal(size=(1000, 2)) + toxic[:, None]
    weights = np.where(toxic > 0, 1.0, 3.0)
    repeated = np.repeat(np.arange(1000), weights.astype(int))
    for a, b in zip(fit_curve(rows, toxic, weights), fit_curve(rows[repeated], toxic[repeated])):
        assert np.allclose(a, b, atol=1e-6)


def test_scores_do_not_depend_on_the_sample(documents, labels, monkeypatch):
    rng = random.Random(9)
    plain, mixed = "table chair window garden river".split(), "grizzled chair window garden river".split()
    rows = [(i, " ".join(rng.choices(mixed if i % 10 == 0 or i % 10 == 5 and i % 4 else plain, k=6))) for i in range(4000)]
    docs, marks = documents(*rows), labels(*[(i, 1, int(i % 10 == 0), "t") for i, _ in rows])
    mean = lambda: np.mean([r.score for r in score_documents(docs, marks).collect()])
    whole = mean()
    assert abs(whole - 0.1) < 0.02
    monkeypatch.setattr(toxicity, "CURVE_ROWS", 120)
    assert abs(mean() - whole) < 0.05


def test_nothing_to_learn_from(odd, labels):
    for given in (labels(), labels((5, 1, 0, "t"), (9, 1, 0, "t"))):
        rows = score_documents(odd, given).collect()
        assert len(rows) == 13 and all((r.score, r.predicted) == (0.0, 0) for r in rows)
    assert score_documents(odd.limit(0), labels()).count() == 0
    assert toxicity.HELD_OUT == 1
