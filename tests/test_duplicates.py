import pytest
from pyspark.sql import functions as F

from tallyframe.operators import dedupe

# Parcels scanned at docks: repeated pairs, a pair with a null, ties and nulls among the weights.
SCANS = [
    ("oslo", 4, 2.5), ("oslo", 7, 1.0), ("oslo", 4, 9.0), (None, 4, None), ("bern", 4, 3.0), ("oslo", 4, 9.0),
    (None, 4, 0.5), ("bern", 4, 3.0), ("oslo", 7, None), ("lima", 1, None), (None, 4, 0.5),
]
KEYS = ["site", "dock"]


def kept_rows(keep):
    """Row numbers that stay, by plain Python."""
    groups = {}
    for i, (site, dock, _) in enumerate(SCANS):
        groups.setdefault((site, dock), []).append(i)
    weight = lambda i: (SCANS[i][2] is not None, SCANS[i][2] or 0, -i)
    pick = {"first": min, "last": max, "highest": lambda rows: max(rows, key=weight)}[keep]
    return {pick(rows) for rows in groups.values()}


@pytest.fixture
def scans(frame):
    return frame("site string, dock long, weight double", *SCANS)


def mask(df, **options):
    flagged = dedupe.mark_duplicates(df, options.pop("keys", KEYS), "row_id", **options)
    return [r.is_duplicate for r in flagged.orderBy("row_id").collect()]


@pytest.mark.parametrize("keep", ["first", "last", "highest"])
def test_mask_and_removal_agree(scans, rows, keep):
    kept = kept_rows(keep)
    assert mask(scans, keep=keep) == [i not in kept for i in range(len(SCANS))]
    assert rows(dedupe.drop_duplicates(scans, KEYS, "row_id", keep), "row_id") == [(i,) for i in sorted(kept)]
    flagged = dedupe.duplicate_rows(scans, KEYS, "row_id", keep)
    assert rows(flagged, "row_id") == [(i,) for i in range(len(SCANS)) if i not in kept]
    narrow = dedupe.duplicate_mask(scans, KEYS, "row_id", keep)
    assert rows(narrow) == [(i, i not in kept) for i in range(len(SCANS))]


def test_flag_name_must_be_free(scans):
    with pytest.raises(ValueError, match="in use"):
        dedupe.mark_duplicates(scans, KEYS, "row_id", mask="Weight")


def test_nulls_and_nans_are_equal_keys(frame):
    df = frame("k double, v long", (None, 1), (float("nan"), 2), (0.0, 3), (-0.0, 4))
    assert mask(df, keys=["k"]) == [False, True, False, True]


def test_highest_prefers_first_on_ties_and_ranks_nulls_last(frame):
    df = frame("k string, score double", ("a", None), ("a", 2.0), ("a", 2.0), ("b", None), ("b", float("nan")))
    assert mask(df, keys=["k"], keep="highest") == [True, False, True, False, True]


def test_highest_without_numbers_keeps_first(frame):
    df = frame("k string, note string, flag boolean", ("a", "x", False), ("a", "y", True))
    assert dedupe.pick_rank_column(df, ["k"], ["row_id"]) is None
    assert mask(df, keys=["k"], keep="highest") == [False, True]


def test_first_numeric_column_ranks(frame):
    df = frame("k string, a long, b long", ("a", 1, 9), ("a", 2, 1))
    assert dedupe.pick_rank_column(df, ["k"], ["row_id"]) == "a"
    assert mask(df, keys=["k"], keep="highest") == [True, False]
    assert mask(df, keys=["k"], keep="highest", rank_by="b") == [False, True]


def test_several_order_columns(frame):
    df = frame("k string, day long, part long", ("a", 2, 1), ("a", 1, 2), ("a", 1, 1))
    flagged = dedupe.mark_duplicates(df, "k", ["day", "part"])
    assert [r.is_duplicate for r in flagged.orderBy("row_id").collect()] == [True, True, False]


def test_report(scans):
    report = dedupe.duplicate_report(scans, KEYS, "last").first()
    assert tuple(report) == ("site, dock", 11, 6, 54.5, "last")


def test_report_of_empty_table(scans):
    report = dedupe.duplicate_report(scans.where("false"), KEYS).first()
    assert (report.total_rows, report.duplicate_rows, report.duplicate_pct) == (0, 0, 0.0)


def test_full_row_duplicates(scans):
    repeated = len(SCANS) - len(set(SCANS))
    assert tuple(dedupe.full_row_duplicates(scans.drop("row_id")).first()) == (len(SCANS), repeated)


def test_column_names_with_blanks_and_dots(frame):
    df = frame("`dock no` string, `a.b` string", ("x", "y"), ("x", "y"), ("x", "z"))
    assert mask(df, keys=["dock no", "a.b"]) == [False, True, False]
    assert dedupe.drop_duplicates(df, ["a.b"], "row_id").count() == 2


@pytest.mark.parametrize(
    "keys, keep, message",
    [([], "first", "key column"), (["weather"], "first", "not found"), (KEYS, "middle", "is none of")],
)
def test_errors_come_before_any_job(scans, keys, keep, message):
    for run in (dedupe.mark_duplicates, dedupe.drop_duplicates):
        with pytest.raises(ValueError, match=message):
            run(scans, keys, "row_id", keep)


def test_dropping_twice_changes_nothing(spark, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    once = dedupe.drop_duplicates(events, ["user_id"], "event_id", "last")
    twice = dedupe.drop_duplicates(once, ["user_id"], "event_id", "last")
    assert rows(once, "event_id") == rows(twice, "event_id")


def test_mask_count_matches_report(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    flagged = dedupe.mark_duplicates(events, ["user_id", "event_type"], "event_id")
    counted = flagged.agg(F.count_if("is_duplicate")).first()[0]
    assert counted == dedupe.duplicate_report(events, ["user_id", "event_type"]).first().duplicate_rows


@pytest.mark.parametrize("keep", ["first", "last", "highest"])
@pytest.mark.parametrize("min_hot_rows", [None, 20])
def test_the_mask_in_one_shuffle(frame, rows, keep, min_hot_rows):
    import random

    draw = random.Random(4)
    cells = [(draw.choice(["x", "x", "x", "y", None]), draw.choice([1.0, -0.0, 0.0, float("nan"), None]), draw.choice([1, 2, None])) for _ in range(300)]
    df = frame("a string, b double, v long", *cells)
    for keys in (["a"], ["a", "b"]):
        one = dedupe.mark_duplicates_once(df, keys, "row_id", keep, min_hot_rows=min_hot_rows)
        other = dedupe.mark_duplicates(df, keys, "row_id", keep)
        assert one.dtypes == other.dtypes and rows(one, "row_id", "is_duplicate") == rows(other, "row_id", "is_duplicate")
    empty = dedupe.mark_duplicates_once(df.limit(0), ["a"], "row_id", keep, min_hot_rows=min_hot_rows)
    assert empty.isEmpty()


def test_rows_of_a_hot_key_stay_in_their_tasks(spark):
    df = spark.range(0, 30_000, 1, 6).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 9000 END AS k", "id AS v")
    plain = dedupe.mark_duplicates_once(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plain.count("Exchange") == 1 and "Join" not in plain
    marked = dedupe.mark_duplicates_once(df, ["k"], "id", min_hot_rows=1000)
    # Cold rows are shuffled; of the hot key's 10,000 rows only a few candidates are.
    sizes = marked.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_if(F.expr("k = -1")).alias("hot")).collect()
    assert sum(r.hot for r in sizes) == 10_000 and max(r.hot for r in sizes) < 2000
    assert marked.where("NOT is_duplicate").count() == df.select("k").distinct().count()


def test_merged_rows_carry_counts(frame, rows):
    df = frame("k string, v long, n long", ("a", 5, 1), ("a", 9, 2), ("b", None, 3), (None, 1, 4), (None, 7, 5))
    merged = dedupe.merge_duplicates(df, ["k"], "row_id", "highest", "v", sums=["n"])
    assert rows(merged, "k", "v", "n", "removed") == [(None, 7, 9, 1), ("a", 9, 3, 1), ("b", None, 3, 0)]
    assert dedupe.merge_duplicates(df, ["v"], "row_id", "highest", "k") is None
