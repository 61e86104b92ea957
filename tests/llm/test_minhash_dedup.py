import random

import numpy as np
import pytest
from conftest import SMALL

from tallyframe.functions.local import local_table
from tallyframe.llm import minhash_dedup
from tallyframe.llm.common import components
from tallyframe.llm.minhash_dedup import drop_near_duplicates, near_duplicates, shingles


def plain_set(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = lowered.encode().split()
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def plain(rows, words=2):
    """(size, component) by id; rows of one id and other text are apart."""
    sets = [(i, plain_set(t, words)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b in range(a):
            j, t = sets[b]
            if i is None or j is None or not s or not t:
                continue
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(find(a), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(
        ((i, len(s), least[find(a)], least[find(a)] == i) for a, (i, s) in enumerate(sets)), key=str
    )


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def near_copies(groups, size, seed=0):
    """Texts with graded changes, so that links run in chains around the limit."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"LONG_LIST": 4, "CHUNK": 3, "HUB_ROWS": 2, "GROUP_CHUNK": 3}])
def test_equals_brute_force(documents, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    rows = near_copies(8, 15)
    assert found(near_duplicates(documents(*rows))) == plain(rows)


def test_five_words(documents):
    rows = near_copies(6, 10, seed=2)
    assert found(near_duplicates(documents(*rows), words=5)) == plain(rows, 5)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(near_duplicates(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(near_duplicates(odd)) == plain(rows)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_a_group_stays(odd, documents):
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, None], key=str)
    twice = documents((1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five"))
    assert [r.doc_id for r in drop_near_duplicates(twice).collect()] == [1]


def test_texts_that_share_an_id_are_kept_apart(documents):
    a, b, c = ("alpha beta gamma delta " * 3, "one two three four five", "red green blue white black")
    rows = documents((3, b), (5, a), (5, b), (5, c), (5, c), (5, "..."), (6, a), (3, "11 --"))
    kept = sorted((r.doc_id, r.text) for r in drop_near_duplicates(rows).collect())
    assert kept == sorted([(3, b), (5, a), (5, c), (5, "..."), (3, "11 --")])
    near = documents((1, c + " and"), (1, c + " AND"), (1, a), *[(1, f"{w} {b} {w}") for w in ("x", "yy", "zzz")])
    texts = [r.text for r in drop_near_duplicates(near, 1, 60).collect()]
    assert len(texts) == 3 and a in texts


def test_shingle_numbers_tell_sets_apart():
    texts = ["a b c a b", "A  b\tc", "ab c", "a bc", "one", "ONE", "", " ", "é b", "a\x00 b", "a b"]
    with np.errstate(over="ignore"):
        found = shingles([t.encode() for t in texts])
        alone = [shingles([t.encode()])[0] for t in texts]
    for a, x in enumerate(texts):
        assert found[a].tolist() == alone[a].tolist()
        assert len(found[a]) == len(plain_set(x, 2))
        for b, y in enumerate(texts):
            assert len(set(found[a]) & set(found[b])) == len(plain_set(x, 2) & plain_set(y, 2))


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 501), (501, 502), (502, 500)]
    links += [(7, 7), (900, 100)]
    df = local_table(spark, links, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {
        **{i: 100 for i in range(100, 161)}, 900: 100, **{i: 1 for i in range(1, 40)}, 500: 500, 501: 500, 502: 500,
    }
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, local):
    from tallyframe.functions.local import local_table
    from tallyframe.llm import common

    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    length = 10_000 if local else 300
    links = [(i + 1, i) for i in range(length)] + [(50_000, 50_000 + i) for i in range(1, 400)] + [(7, 7), (90_000, 90_001)]
    rng = np.random.default_rng(1)
    links = [links[i] for i in rng.permutation(len(links))]
    got = {r.node: r.root for r in common.components(local_table(spark, links, "a long, b long")).collect()}
    expected = {i: 0 for i in range(length + 1)} | {50_000 + i: 50_000 for i in range(400)} | {90_000: 90_000, 90_001: 90_000}
    assert got == expected
    assert common.components(local_table(spark, [], "a long, b long")).count() == 0
