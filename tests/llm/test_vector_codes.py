import hashlib
import math

import numpy as np
import pytest
from conftest import SMALL

from tallyframe.functions.local import local_table
from tallyframe.llm.vector_codes import Assigner, compress, decode, learn, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry long"


def plain(rows, parts=8, entries=16, rounds=6):
    """Vectors one at a time, in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dims = max((len(r[1]) for r in kept), default=0)
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)), g) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [p * dims // parts for p in range(parts + 1)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        away = [sum((x - y) ** 2 for x, y in zip(part(v, p), e)) for e in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        books = [
            [
                [sum(c) // len(own) for c in zip(*own)] if own else entry
                for entry, own in (
                    (entry, [part(v, p) for _, v, _ in kept if nearest(v, p)[0] == e]) for e, entry in enumerate(books[p])
                )
            ]
            for p in range(parts)
        ]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[g], digest) for i, c, e, g in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("rows_in", [5, 16, 150])
def test_equals_brute_force(spark, rows_in):
    rng = np.random.default_rng(rows_in)
    middles = rng.standard_normal((4, 16))
    rows = [(int(i), (middles[i % 4] + rng.standard_normal(16) * 0.3).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(rows_in)]
    rows += rows[: rows_in // 5]
    df = local_table(spark, [(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert found(compress(df)) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5] * 10, 0), (1, [0.25] * 10, None), (2, None, 0), (3, [], 0), (4, [0.0] * 10, None), (5, [1.0, None], 1),
        (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [-0.3, 0.7, 100.0], 1), (None, [0.1] * 10, 1), (9, [0.5] * 10, 0),
    ]
    df = local_table(spark, [(*r, "x", 1) for r in rows], SCHEMA)
    assert found(compress(df)) == plain(rows)
    assert compress(df.limit(0)).count() == 0


def test_cells_spare_work_and_change_nothing():
    rng = np.random.default_rng(3)
    book = rng.integers(-2000, 2000, (16, 4))
    near_entries = book[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 4))
    for points in (near_entries, rng.integers(-4000, 4000, (3000, 4))):
        for cells in (0, 10, 100_000):
            assigner = Assigner(book, cells)
            entries, away = assigner(points)
            exact = ((points[:, None] - book[None]) ** 2).sum(2)
            assert (entries == exact.argmin(1)).all() and (away == exact.min(1)).all()
            assert len(assigner.known) <= cells
    assigner = Assigner(book)
    assigner(near_entries)
    assert assigner.evaluated < 3000 * 16 / 3


def test_ties_go_to_the_lower_entry():
    book = np.array([[0, 0], [4, 0], [0, 0], [4, 0]])
    entries, away = Assigner(book)(np.array([[2, 0], [4, 1], [0, 0], [3, 0]]))
    assert entries.tolist() == [0, 1, 0, 1] and away.tolist() == [4, 1, 0, 1]


def test_codes_stand_for_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    numbers, dims = whole_numbers(df)
    books = learn(numbers, dims)
    own = {r.vec_id: np.array(r.numbers) for r in numbers.collect()}
    for r in compress(df).collect():
        assert ((decode(r.code, books) - own[r.vec_id]) ** 2).sum() == r.error
    assert found(compress(df)) == plain([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
