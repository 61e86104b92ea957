from tallyframe.functions.local import local_table
from tallyframe.operators import dedupe, profile
from tallyframe.sources.reports import profile_tables, size_text
from pyspark.sql import functions as F


def by_column(df):
    return {r.column: r for r in df.collect()}


def test_profile(frame):
    df = frame("id long, name string", (1, "a"), (2, "b"), (3, "b"), (None, "c"))
    found = by_column(profile.profile_columns(df, ["id", "name"]))
    assert (found["id"].row_count, found["id"].null_count, found["id"].null_pct) == (4, 1, 25.0)
    assert (found["id"].unique_count, found["id"].unique_pct, found["id"].duplicate_pct) == (3, 75.0, 0.0)
    assert (found["id"].min_value, found["id"].max_value, found["id"].is_numeric) == (1.0, 3.0, True)
    assert (found["name"].unique_count, found["name"].duplicate_pct) == (3, 25.0)
    assert (found["name"].min_value, found["name"].dtype) == (None, "string")
    assert (found["name"].min_length, found["name"].max_length) == (1, 1)


def test_thirds_are_rounded(frame):
    df = frame("VIN string", ("A1",), ("A1",), ("A2",))
    found = by_column(profile.profile_columns(df, ["VIN"]))["VIN"]
    assert (found.unique_pct, found.duplicate_pct) == (66.67, 33.33)


def test_nan_is_null_and_zero_has_one_sign(frame):
    df = frame("x double", (float("nan"),), (0.0,), (-0.0,), (None,))
    found = by_column(profile.profile_columns(df, ["x"]))["x"]
    assert (found.null_count, found.unique_count) == (2, 1)


def test_all_null_and_empty_tables(frame):
    df = frame("x long, y string", (None, "a"))
    found = by_column(profile.profile_columns(df, ["x", "y"]))["x"]
    assert (found.null_pct, found.unique_count, found.min_value, found.max_length) == (100.0, 0, None, None)
    for run in (profile.profile_columns, profile.profile_columns_approx):
        empty = by_column(run(df.where("false"), ["x", "y"]))
        assert set(empty) == {"x", "y"}
        assert (empty["x"].row_count, empty["x"].null_pct, empty["x"].duplicate_pct) == (0, 0.0, 0.0)


def test_nested_and_temporal_columns(spark):
    df = spark.sql("SELECT array(1, 2) AS a, DATE '2024-01-01' AS d, X'01' AS b, CAST(1.50 AS DECIMAL(5,2)) AS n")
    found = by_column(profile.profile_columns(df))
    assert found["a"].unique_count == 1 and found["n"].max_value == 1.5 and found["d"].max_length == 10


def test_examples_in_row_order(frame):
    values = ["b", None, "a", "b", "c", "d", "e", "f"]
    df = frame("v string, n long", *[(v, i) for i, v in enumerate(values)])
    found = {r.column: r.examples for r in profile.example_values(df, "row_id").collect()}
    assert found["v"] == ["b", "a", "c", "d", "e"]
    assert found["n"] == ["0", "1", "2", "3", "4"]


def test_examples_come_from_the_whole_column(spark):
    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 1000 = 999 THEN id END AS rare", "concat('x', id DIV 700) AS often", "NULL AS none"
    )
    found = {r.column: r.examples for r in profile.example_values(df, "id").collect()}
    assert found == {"rare": ["999", "1999", "2999"], "often": ["x0", "x1", "x2", "x3", "x4"], "none": []}
    two = {r.column: r.examples for r in profile.example_values(df, ["often", "id"], ["rare"], 2).collect()}
    assert two == {"rare": ["999", "1999"]}


def test_statistics_share_one_shuffle_and_run_nothing_early(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "none expected")
    report = profile.column_statistics(df, "id")
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["Example Values"] for r in report.orderBy("ordinal").collect()] == ["0, 1, 2", "0, 1, 2"]


def test_maps_are_compared(spark):
    df = spark.sql("SELECT map('x', id % 2) AS m, 1 AS k FROM range(4)")
    assert tuple(dedupe.full_row_duplicates(df).first()) == (4, 2)
    assert profile.table_metadata(df).first().duplicate_rows == 2


def test_report_table(frame):
    df = frame(
        "code long, side string, level double",
        (7, "north", -2.25), (8, "east", 4.0), (None, "east", 4.0), (9, "west", None),
    )
    report = profile.column_statistics(df, "row_id", ["code", "side", "level"]).orderBy("ordinal").collect()
    assert [r["Column"] for r in report] == ["code", "side", "level"]
    assert report[0]["Example Values"] == "7, 8, 9" and report[0]["Null %"] == 25.0
    assert (report[2]["Min"], report[2]["Max"]) == (-2.25, 4.0)
    tables = profile_tables(df, "row_id", ["code", "side", "level"])
    summary = {r.Metric: r.Value for r in tables["summary"].collect()}
    assert summary == {
        "Row Count": "4", "Column Count": "3", "Duplicate Rows": "0", "Blank Cells": "2", "Fill Rate": "83.3",
    }


def test_table_metadata(frame):
    df = frame("site string, dock long", ("oslo", 4), ("oslo", 4), ("bern", 4)).drop("row_id")
    assert tuple(profile.table_metadata(df).first()) == (3, 2, 1, 0, 100.0)
    assert tuple(profile.table_metadata(df.where("false")).first()) == (0, 2, 0, 0, 0.0)


def test_null_shares(frame):
    df = frame("a long, b string", (1, None), (None, None), (3, "x"))
    shares = {r.column: r.null_pct for r in profile.null_shares(df, ["a", "b"]).collect()}
    assert shares == {"a": 33.33, "b": 66.67}


def test_size_text(spark):
    sizes = [(5,), (1536,), (5 * 1024**2,), (3 * 1024**3,), (2 * 1024**4,)]
    df = local_table(spark, sizes, "n long").select("n", size_text(F.col("n")).alias("t"))
    assert [r.t for r in df.orderBy("n").collect()] == ["5 B", "1.5 KB", "5.0 MB", "3.0 GB", "2.0 TB"]
