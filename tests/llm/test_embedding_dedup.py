import numpy as np
import pytest
from conftest import SMALL

from tallyframe.functions.local import local_table
from tallyframe.llm import embedding_dedup
from tallyframe.llm.embedding_dedup import near_duplicates, parameters

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cid string"


def plain(rows):
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or not vector or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if any(vector):
            v = np.array(vector, np.float32).astype(float)
            usable[i] = (v / np.sqrt(v @ v), label)
    links = {i: set() for i, _, _ in rows}
    for a in usable:
        for b in usable:
            if a < b and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]):
                if usable[a][0] @ usable[b][0] >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    root = {}
    for i in sorted(links, key=lambda x: (x is None, x)):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("chunk", [1024, 8])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        middle = rng.standard_normal(24)
        for _ in range(20):
            rows.append((len(rows), (middle + rng.standard_normal(24) * 0.15).astype(np.float32).tolist(), group % 3))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 2)]
    df = local_table(spark, [(*r, 1, "x") for r in rows], SCHEMA)
    assert found(near_duplicates(df)) == plain(rows)


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, one, 0), (2, one, 0), (3, [2.0, 4.0, 6.0], 0), (4, one, 1), (5, one, None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 3.0], 0), (10, [1.0, nan, 3.0], 0), (11, [inf, 2.0, 3.0], 0),
        (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0), (None, one, 0),
    ]
    df = local_table(spark, [(*r, 1, "x") for r in rows], SCHEMA)
    assert found(near_duplicates(df)) == plain(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_link_like_equal_vectors(spark):
    df = local_table(spark, [(1, [1.0, 0.0], 0, 1, "x")] * 3 + [(2, [0.0, 1.0], 0, 1, "x")], SCHEMA)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 2, 1, True)] * 3 + [(2, 0, 2, True)]


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert found(near_duplicates(df)) == plain([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_parameters_grow_with_the_table():
    small, large = parameters(1000), parameters(10**9)
    assert small[0] < large[0] and small[1] < large[1]


def test_buckets_that_share_a_number_are_compared_apart(spark, monkeypatch):
    """All buckets get one of three numbers."""
    from pyspark.sql import functions as F

    plain_postings = embedding_dedup._postings
    few = lambda *args: plain_postings(*args).withColumn("bucket", F.pmod("bucket", F.lit(3)))
    monkeypatch.setattr(embedding_dedup, "_postings", few)
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((6, 8))
    rows = [(i, (middles[i % 6] + rng.standard_normal(8) * 0.05).astype(np.float32).tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, rows[i][1][:7], i % 3) for i in range(12)]
    df = local_table(spark, [(*r, 1, "x") for r in rows], SCHEMA)
    assert found(near_duplicates(df)) == plain(rows)
