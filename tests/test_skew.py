"""Joins with hot keys give the same rows as plain joins and spread the hot rows."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table
from tallyframe.operators import compare, rules, skew
from tallyframe.operators.combine import join_tables
from tallyframe.operators.lookup import lookup_and_copy
from tallyframe.operators.skew import _cut, hot_keys, skew_join

MODES = ["inner", "left", "right", "full_outer", "left_semi", "left_anti"]


def side(spark, prefix, counts):
    """``counts`` rows per key; every row has its own number."""
    rows, n = [], 0
    for key, count in counts:
        for _ in range(count):
            rows.append((key, n))
            n += 1
    return local_table(spark, rows, f"k long, {prefix}id long")


LEFT = [(None, 40), (1, 60), (2, 30), (3, 1), (4, 2), (5, 25), (7, 1)]
RIGHT = [(None, 3), (1, 2), (2, 20), (4, 1), (6, 30), (7, 22), (8, 1)]


def expected(left, right, mode):
    joined = left.join(right.withColumnRenamed("k", "rk"), F.col("k").eqNullSafe(F.col("rk")), mode)
    if mode in ("left_semi", "left_anti"):
        return joined.select("k", "lid")
    return joined.select(F.coalesce("k", "rk").alias("k"), "lid", "rid")


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("swap", [False, True])
def test_same_rows_as_a_plain_join(spark, rows, mode, swap):
    left_counts, right_counts = (RIGHT, LEFT) if swap else (LEFT, RIGHT)
    left, right = side(spark, "l", left_counts), side(spark, "r", right_counts)
    hot = skew_join(left, right, ["k"], mode, min_hot_rows=5, buckets=16)
    names = ["k", "lid"] if mode in ("left_semi", "left_anti") else ["k", "lid", "rid"]
    assert rows(hot, *names) == rows(expected(left, right, mode), *names)


def test_hot_keys_and_their_kinds(spark):
    left, right = side(spark, "l", LEFT), side(spark, "r", RIGHT)
    hot = hot_keys(left, right, ["k"], min_hot_rows=19, buckets=16)
    assert {row[0] for row in hot.rows} == {None, 1, 2, 5, 6, 7}
    both, alone = ({row[0] for row in kind} for kind in hot.kinds())
    assert (both, alone) == ({None, 1, 2, 7}, {5, 6})
    cuts = {r.k: tuple(r)[1:] for r in hot.table(hot.rows).collect()}
    assert cuts[1] == (4, 1) and cuts[2] == (2, 2) and cuts[6] == (1, 2)


def test_hot_means_a_number_of_rows_whatever_the_table(spark):
    left = spark.range(20_000).selectExpr("id % 5000 AS k", "id AS lid")
    right = local_table(spark, [(1, 1)], "k long, rid long")
    assert hot_keys(left, right, ["k"], min_hot_rows=4, buckets=16) is None
    assert len(hot_keys(left, right, ["k"], min_hot_rows=3, buckets=16).rows) == 5000


def test_no_hot_keys_means_a_plain_join(spark):
    left, right = side(spark, "l", LEFT), side(spark, "r", RIGHT)
    assert hot_keys(left, right, ["k"]) is None


def test_rows_hot_on_both_sides_are_spread_evenly(spark):
    left, right = side(spark, "l", [(1, 4000), (2, 5)]), side(spark, "r", [(1, 1000)])
    hot = hot_keys(left, right, ["k"], min_hot_rows=400, buckets=16)
    cut = _cut(left, hot.table(hot.rows), ["k"], "left", "right")
    sizes = [r["count"] for r in cut.groupBy("__piece_left", "__piece_right").count().collect()]
    assert len(sizes) == 10 * 3 and max(sizes) < 500


def test_identical_hot_rows_are_spread(spark):
    copies = spark.range(40_000).selectExpr("1L AS k", "'same' AS l")
    few = spark.range(200).selectExpr("1L AS k", "'x' AS r")
    joined = skew_join(copies, few, ["k"], "left", min_hot_rows=500, buckets=16)
    assert joined.count() == 40_000 * 200
    hot = hot_keys(copies, few, ["k"], min_hot_rows=500, buckets=16)
    cut = _cut(copies, hot.table(hot.rows), ["k"], "left", "right")
    sizes = [r["count"] for r in cut.groupBy("__piece_left").count().collect()]
    assert len(sizes) == 80 and max(sizes) <= 600
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = skew_join(copies, few, ["k"], "inner", min_hot_rows=500, buckets=16)
        tasks = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 4 and max(tasks) < 0.5 * 40_000 * 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_marking_counted_keys(spark, rows):
    df = side(spark, "l", LEFT)
    counted = df.groupBy("k").agg(F.count("*").alias("__n")).where("__n > 1")
    marked = skew.mark_counted(df, counted, ["k"], "often", limit=7)
    assert marked.columns == ["k", "lid", "often"]
    assert rows(marked.groupBy("k", "often").count()) == sorted(
        [(k, n > 1, n) for k, n in LEFT], key=lambda r: (r[0] is not None, r[0] or 0)
    )


def test_instants_as_hot_keys(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        left = spark.range(40).selectExpr("timestamp_seconds(id DIV 20) AS k", "id AS lid")
        right = spark.range(1, 3).selectExpr("timestamp_seconds(id) AS k", "id AS rid")
        joined = skew_join(left, right, ["k"], "full_outer", min_hot_rows=5, buckets=8)
        assert rows(joined.groupBy("rid").count()) == [(None, 20), (1, 20), (2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_two_text_keys(spark, rows):
    data = [("a", None, i) for i in range(30)] + [("a", "b", 100), (None, "b", 101)]
    left = local_table(spark, data, "x string, y string, lid long")
    right = local_table(spark, [("a", None, 1), (None, "b", 2)], "x string, y string, rid long")
    joined = skew_join(left, right, ["x", "y"], "left", right_unique=True, min_hot_rows=5, buckets=8)
    assert joined.count() == 32
    assert rows(joined.groupBy("rid").count()) == [(None, 1), (1, 30), (2, 1)]


@pytest.mark.parametrize("mode", ["inner", "left", "right", "outer"])
def test_table_join_with_hot_keys(spark, rows, mode):
    left, right = side(spark, "l", LEFT), side(spark, "r", RIGHT)
    assert rows(join_tables(left, right, ["k"], mode, min_hot_rows=5)) == rows(
        join_tables(left, right, ["k"], mode)
    )


def test_operators_with_hot_keys(spark, rows):
    left, right = side(spark, "l", LEFT), side(spark, "r", RIGHT)
    a, b = left.withColumnRenamed("lid", "v"), right.withColumnRenamed("rid", "v")
    assert rows(compare.compare_tables(a, b, ["k"], min_hot_rows=5), "k", "status", "v_master", "v_second") \
        == rows(compare.compare_tables(a, b, ["k"]), "k", "status", "v_master", "v_second")
    assert rows(compare.rows_missing(a, b, ["k"], min_hot_rows=5)) == rows(compare.rows_missing(a, b, ["k"]))
    copied = lookup_and_copy(left, right, "k", ["rid"], "rid", min_hot_rows=5)
    assert rows(copied) == rows(lookup_and_copy(left, right, "k", ["rid"], "rid"))
    unique = [rules.Rule("unique", "k")]
    assert rows(rules.validate(left, unique, "lid", min_hot_rows=5)) == rows(
        rules.validate(left, unique, "lid")
    )
