import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table
from tallyframe.llm import vector_forest
from tallyframe.llm.vector_forest import Forest, leaves_to_open, nearest, nearest_of_every

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, h1 long"


def plain(rows, every, k=10):
    usable = []
    dims = max((len(v) for _, v in rows if v), default=1)
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append((i, np.array(v + [0.0] * (dims - len(v)), np.float32).astype(float)))
    out = {}
    for q, v in usable:
        if q % every == 0:
            for i, w in usable:
                if i != q:
                    score = float(np.sqrt(((v - w) ** 2).sum()))
                    out.setdefault(q, {})[i] = min(score, out.get(q, {}).get(i, score))
    return {q: sorted((s, i) for i, s in near.items())[:k] for q, near in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, exact):
    assert got.keys() == exact.keys()
    for q in exact:
        assert len(got[q]) == len(exact[q]) and got[q] == sorted(got[q]) and len({i for _, i in got[q]}) == len(got[q])
    return np.mean([np.mean([g <= e[-1] for g in got[q]]) for q, e in exact.items()])


@pytest.fixture
def small_forest(monkeypatch):
    """Many leaves, pieces and chunks on few rows."""
    for name, value in {"LEAF": 8, "SAMPLE": 1024, "SAMPLE_LEAF": 4, "PIECE": 32, "BLOCK": 4}.items():
        monkeypatch.setattr(vector_forest, name, value)


def test_clustered_vectors(spark, small_forest):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((40, 16))
    rows = [(i, (middles[i % 40] + rng.standard_normal(16) * 0.2).astype(np.float32).tolist()) for i in range(2000)]
    df = local_table(spark, [(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(5)
    got, exact = found(nearest_of_every(df, 20)), plain(rows, 20)
    assert recall(got, exact) >= 0.9
    scores = dict(enumerate(r[1] for r in rows))
    for q, near in list(got.items())[:20]:
        for score, i in near:
            away = np.float64(np.float32(scores[q])) - np.float64(np.float32(scores[i]))
            assert abs(score - np.sqrt((away**2).sum())) < 1e-12


def test_one_vector_in_a_third_of_the_rows(spark, small_forest):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).astype(np.float32).tolist()) for i in range(900)]
    df = local_table(spark, [(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    got, exact = found(nearest_of_every(df, 10)), plain(rows, 10)
    assert recall(got, exact) >= 0.9
    assert all(got[q] == exact[q] for q in got if q % 3 == 0)


def test_odd_vectors_and_few_rows(spark):
    one, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [
        (0, one), (100, [1.0, 2.0, 3.5]), (200, [0.0, 0.0, 0.0]), (300, None), (400, []), (500, [1.0, nan, 2.0]),
        (600, [1.0, None, 2.0]), (None, one), (7, one), (7, one), (8, [1.0, 2.0]), (9, [3.0, 2.0, 1.0]), (9, [1.0, 2.0, 3.0]),
        (0, [9.0, 9.0, 9.0]), (5, [-0.0, 1.0, 0.0]), (6, [0.0, 1.0, 0.0]),
    ]
    df = local_table(spark, [(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    assert found(nearest_of_every(df)) == plain(rows, 100)
    assert nearest_of_every(df.limit(0)).count() == 0
    assert nearest_of_every(df.where("vec_id = 100")).count() == 0


def test_own_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(300)]
    df = local_table(spark, [(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    asked = df.where("vec_id < 5").select((F.col("vec_id") - 100).alias("query_id"), "embedding")
    got = found(nearest(asked, df, k=3))
    assert {q: near[0] for q, near in got.items()} == {i - 100: (0.0, i) for i in range(5)}


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    exact = plain([(r.vec_id, list(r.embedding)) for r in df.collect()], 100)
    assert recall(found(nearest_of_every(df)), exact) >= 0.9


def test_search_opens_every_leaf_once_and_the_own_first():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 12))
    forest = Forest(vectors[:1000], 3000, 3, 32)
    leaves = forest.leaves(vectors)
    assert forest.depth == 5 and np.bincount(leaves[:, 0]).max() < 3 * 3000 / 32
    opened = list(forest.search(forest.project(vectors[7])))
    assert len(opened) == len(set(opened)) == 3 * 32
    assert set(opened[:3]) == set(enumerate(leaves[7].tolist()))
    one = leaves_to_open(forest, vectors[7:8], [(0, leaves[7].tolist())])
    assert one == 1
