import tracemalloc
import zlib

import numpy as np
import pytest
from conftest import SMALL

from tallyframe.llm import sharding
from tallyframe.llm.sharding import difference, shard


def loads(sizes, part, parts):
    return np.bincount(part, np.asarray(sizes, float), parts)


def test_textbook_differencing():
    # Two parts of 8, 7, 6, 5, 4: differencing ends with a difference of 2.
    assert sorted(loads([8, 7, 6, 5, 4], difference([8, 7, 6, 5, 4], 2), 2)) == [14, 16]
    assert sorted(loads([5, 5, 5], difference([5, 5, 5], 3), 3)) == [5, 5, 5]
    assert difference([], 4).tolist() == []
    assert len(difference([9], 4)) == 1


def test_closer_than_dealing_largest_first():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(10, 5000, 2000))[::-1]
    greedy = np.zeros(40)
    for size in sizes:
        greedy[greedy.argmin()] += size
    found = loads(sizes, difference(sizes, 40), 40)
    assert found.sum() == sizes.sum()
    assert found.max() - found.min() <= greedy.max() - greedy.min()


def plain_difference(sizes, parts):
    """Differencing on lists of (load, items), without a heap."""
    partials = [[(0, [])] * (parts - 1) + [(s, [i])] for i, s in enumerate(sizes)]
    while len(partials) > 1:
        partials.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = partials.pop(), partials.pop()
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        partials.append(sorted(merged, key=lambda x: x[0]))
    return {frozenset(items) for _, items in partials[0] if items}


@pytest.mark.parametrize("parts", [2, 3, 7, 40])
def test_differencing_against_a_plain_version(parts):
    # Sizes so large that spreads are never equal.
    sizes = np.random.default_rng(parts).integers(10**9, 10**15, 200)
    found = difference(sizes, parts)
    groups = {frozenset(np.flatnonzero(found == p).tolist()) for p in range(parts)} - {frozenset()}
    assert groups == plain_difference(sizes.tolist(), parts)


def test_memory_of_a_full_bucket():
    sizes = np.random.default_rng(3).integers(100, 10_000, sharding.BUCKET_ITEMS)
    tracemalloc.start()
    found = difference(sizes, sharding.MOST_PARTS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == sharding.BUCKET_ITEMS
    assert peak < 100 << 20


@pytest.mark.parametrize("limits", [{}, {"BUCKET_ITEMS": 40, "FINE_ITEMS": 10, "LAST_ITEMS": 30, "ROWS_PER_BUCKET": 9}])
def test_shards_of_the_given_table(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sharding, name, value)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in shard(docs).collect()}
    homes, sizes, slots = {}, [0] * 40, [[] for _ in range(40)]
    for doc in docs.collect():
        row, data = rows[doc.doc_id], doc.text.encode()
        assert (row["size"], row.text_crc32, row.law, row.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert homes.setdefault(doc.text, row.shard) == row.shard
        sizes[row.shard] += row["size"]
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(sum(rows[d.doc_id]["size"] for d in docs.collect() if d.text == t) for t in homes)
    assert max(sizes) <= max(sum(sizes) / 40 + largest, largest)


def test_a_giant_group_stays_together(documents):
    rows = [(i, "copy " * 50) for i in range(300)] + [(1000 + i, f"text number {i}") for i in range(400)]
    out = shard(documents(*rows)).collect()
    home = {r.shard for r in out if r.doc_id < 1000}
    assert len(home) == 1
    others = [0] * 40
    for r in out:
        others[r.shard] += r["size"] * (r.doc_id >= 1000)
    assert others[home.pop()] == 0  # what is left goes elsewhere
    rest = sorted(others)[1:]
    assert rest[-1] - rest[0] <= 40


def test_odd_rows(odd):
    out = shard(odd).collect()
    assert len(out) == 13
    empty = [r for r in out if r.doc_id in (1, 2)]
    assert {(r["size"], r.text_crc32) for r in empty} == {(16, 0)} and len({r.shard for r in empty}) == 1
    assert len({r.shard for r in out if r.doc_id in (7, 8)}) == 1
    assert shard(odd.limit(0)).count() == 0
