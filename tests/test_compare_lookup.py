import pytest
from pyspark.sql import functions as F

from tallyframe.functions.local import local_table
from tallyframe.operators import compare
from tallyframe.operators.lookup import lookup_and_copy, lookup_report


COLUMNS = "tank long, content string, litres double"
MORNING = [(t, ("milk", "oil", None)[t % 3], float(t)) for t in range(1, 13)] + [(None, "rain", None)]
# In the evening three tanks are gone, two are new, one was refilled, one holds something else.
EVENING = [
    (t, "juice" if t == 5 else c, 99.0 if t == 6 else v) for t, c, v in MORNING if t not in (2, 3, 11)
] + [(20, "oil", None), (21, None, 2.0)]


@pytest.fixture
def tanks(spark):
    return local_table(spark, MORNING, COLUMNS), local_table(spark, EVENING, COLUMNS)


def expected_pairs():
    first, second = ({t: rest for t, *rest in side} for side in (MORNING, EVENING))
    out = {}
    for tank in first.keys() | second.keys():
        if tank not in second:
            out[tank] = ("missing_in_second", [])
        elif tank not in first:
            out[tank] = ("new_in_second", [])
        else:
            names = ["content", "litres"]
            changed = [n for n, a, b in zip(names, first[tank], second[tank]) if a != b]
            out[tank] = ("modified" if changed else "unchanged", changed)
    return out


def test_statuses_and_changed_columns(tanks):
    pairs = compare.compare_tables(*tanks, ["tank"])
    assert {r.tank: (r.status, r.changed_columns) for r in pairs.collect()} == expected_pairs()
    changed = pairs.where("tank = 5").first()
    assert (changed.content_master, changed.content_second) == (None, "juice")
    counts = {}
    for status, _ in expected_pairs().values():
        counts[status] = counts.get(status, 0) + 1
    summary = compare.compare_summary(pairs, ["tank"]).first()
    assert summary.matched == counts["modified"] + counts["unchanged"] == 10
    assert (summary.missing_in_second, summary.new_in_second, summary.modified) == (3, 2, 2)


def test_missing_is_new_the_other_way_round(tanks, rows):
    morning, evening = tanks
    assert rows(compare.rows_missing(morning, evening, ["tank"]), "tank") == [(2,), (3,), (11,)]
    assert rows(compare.rows_missing(evening, morning, ["tank"]), "tank") == [(20,), (21,)]


def test_equal_tables_have_no_differences(tanks):
    morning, _ = tanks
    pairs = compare.compare_tables(morning, morning, ["tank", "content"])
    assert pairs.where("status <> 'unchanged'").isEmpty()


def test_result_names_must_differ(spark, tanks):
    named = local_table(spark, [(1, "x")], "tank long, Status string")
    for sides in ((tanks[0], named), (named, tanks[0])):
        with pytest.raises(ValueError, match="one name"):
            compare.compare_tables(*sides, ["tank"])


def test_whole_numbers_beyond_doubles_stay_apart(spark, rows):
    big = 2**53
    a = local_table(spark, [(big,), (big + 1,), (3,), (None,)], "k long")
    b = local_table(spark, [(float(big),), (3.0,), (3.5,), (None,)], "k double")
    pairs = compare.compare_tables(a, b, ["k"])
    assert rows(pairs.groupBy("status").count()) == [("missing_in_second", 1), ("new_in_second", 1), ("unchanged", 3)]


def test_null_keys_match_and_numbers_compare_by_value(spark, rows):
    a = local_table(spark, [(None, 30), (1, 5)], "k long, v long")
    b = local_table(spark, [(None, 30.0), (1.0, None)], "k double, v double")
    pairs = compare.compare_tables(a, b, ["k"])
    assert rows(pairs, "k", "status") == [(None, "unchanged"), (1.0, "modified")]


def test_text_null_is_not_null(spark, rows):
    a = local_table(spark, [(None, "nan"), ("__NULL__", None)], "k string, v string")
    b = local_table(spark, [("__NULL__", None), (None, None)], "k string, v string")
    assert rows(compare.compare_tables(a, b, ["k"]), "k", "status") == [
        (None, "modified"), ("__NULL__", "unchanged"),
    ]


def test_key_options_do_not_touch_values(spark, rows):
    a = local_table(spark, [(" Ab ", "X")], "k string, v string")
    b = local_table(spark, [("aB", "x")], "k string, v string")
    assert rows(compare.compare_tables(a, b, ["k"]), "status") == [
        ("missing_in_second",), ("new_in_second",),
    ]
    pairs = compare.compare_tables(a, b, ["k"], ignore_case=True, ignore_whitespace=True)
    assert rows(pairs, "k", "status") == [(" Ab ", "modified")]


def test_unshared_columns_are_kept(spark):
    a = local_table(spark, [(1, "x")], "k long, only_a string")
    b = local_table(spark, [(1, "y")], "k long, only_b string")
    row = compare.compare_tables(a, b, ["k"]).first()
    assert (row.status, row.only_a, row.only_b) == ("unchanged", "x", "y")


def test_repeated_keys_pair_up(spark):
    a = local_table(spark, [(1, "x"), (1, "y")], "k long, v string")
    b = local_table(spark, [(1, "x"), (1, "x"), (1, "z")], "k long, v string")
    summary = compare.compare_summary(compare.compare_tables(a, b, ["k"]), ["k"]).first()
    assert (summary.matched, summary.modified) == (6, 4)


@pytest.mark.parametrize("keys", [[], ["barrel"], ["tank", "barrel"]])
def test_compare_errors(tanks, keys):
    with pytest.raises(ValueError):
        compare.compare_tables(*tanks, keys)
    with pytest.raises(ValueError):
        compare.compare_tables(tanks[0], tanks[1].drop("litres"), ["litres"])


# Stations with their heights, the first of repeated names counting; readings to be completed.
STATIONS = [("alta", 469, "n"), ("bode", 88, None), ("alta", 1, "s"), (None, 7, "x"), ("cima", None, "w")]
READINGS = [("cima", 5), ("alta", None), ("dune", 3), (None, None), ("alta", 2), ("bode", 1)]


@pytest.fixture
def stations(frame):
    master = frame("station string, height long, side string", *STATIONS)
    return frame("station string, height long", *READINGS), master


def first_station():
    found = {}
    for name, *rest in STATIONS:
        found.setdefault(name, rest)
    return found


def test_lookup_overwrites_matched_rows(stations):
    target, master = stations
    found = lookup_and_copy(target, master, "station", ["height"], "row_id", matched="hit")
    known = first_station()
    expected = [(n, known[n][0] if n in known else h, n in known) for n, h in READINGS]
    assert [(r.station, r.height, r.hit) for r in found.orderBy("row_id").collect()] == expected
    assert tuple(lookup_report(target, master, "station").first()) == ("station", 5, 1)


def test_lookup_adds_a_new_column(stations):
    target, master = stations
    found = lookup_and_copy(target, master, "station", ["side"], "row_id")
    known = first_station()
    expected = [known[n][1] if n in known else None for n, _ in READINGS]
    assert [r.side for r in found.orderBy("row_id").collect()] == expected


def test_lookup_composite_keys(frame):
    master = frame(
        "line long, stop string, zone long", *[(i % 4, "abc"[i % 3], i) for i in range(24)], (None, "a", 50)
    )
    target = frame("line long, stop string", (0, "a"), (0, "d"), (3, "b"), (None, "a"), (9, "c"))
    found = lookup_and_copy(target, master, ["line", "stop"], ["zone"], "row_id")
    assert [r.zone for r in found.orderBy("row_id").collect()] == [0, None, 7, 50, None]
    assert tuple(lookup_report(target, master, ["line", "stop"]).first()) == ("line + stop", 3, 2)


def test_composite_keys_never_run_together(frame):
    master = frame("a string, b string, v long", ("a||b", "c", 1))
    target = frame("a string, b string", ("a", "b||c"))
    assert lookup_and_copy(target, master, ["a", "b"], ["v"], "row_id").first().v is None


def test_first_master_row_wins_and_target_rows_stay(frame, rows):
    master = frame("k long, v string", (1, "first"), (1, "second"), (None, "none"))
    target = frame("k long, t long", (1, 1), (1, 2), (None, 3), (2, 4))
    found = lookup_and_copy(target, master, "k", ["v"], "row_id")
    assert rows(found, "t", "v") == [(1, "first"), (2, "first"), (3, "none"), (4, None)]


def test_overwrite_with_null_and_keeping_existing(frame, rows):
    master = frame("k long, v string", (1, None), (2, "new"))
    target = frame("k long, v string", (1, "own"), (2, "own"), (3, "own"))
    found = lookup_and_copy(target, master, "k", ["v"], "row_id")
    assert rows(found, "k", "v") == [(1, None), (2, "new"), (3, "own")]
    kept = lookup_and_copy(target, master, "k", ["v"], "row_id", overwrite_existing=False)
    assert rows(kept, "k", "v", "v_copied") == [(1, "own", None), (2, "own", "new"), (3, "own", None)]
    again = lookup_and_copy(kept, master, "k", ["v"], "row_id", overwrite_existing=False)
    assert again.columns == kept.columns


def test_lookup_key_options(frame):
    master = frame("k string, v long", (" AB ", 1))
    target = frame("k string", ("ab",))
    assert lookup_and_copy(target, master, "k", ["v"], "row_id").first().v is None
    options = {"ignore_case": True, "ignore_whitespace": True}
    assert lookup_and_copy(target, master, "k", ["v"], "row_id", **options).first().v == 1
    assert lookup_report(target, master, "k", **options).first().matched == 1


@pytest.mark.parametrize(
    "match, copied",
    [([], ["height"]), (["town"], ["height"]), (["station"], []), (["station"], ["town"]), (["station"], ["station"])],
)
def test_lookup_errors(stations, match, copied):
    with pytest.raises(ValueError):
        lookup_and_copy(*stations, match, copied, "row_id")


def random_sides(frame, seed, unique=False):
    import random

    draw = random.Random(seed)
    texts = ["a", "A ", "b", None, ""]
    numbers = [1, 2, None, 3]

    def side(wide):
        rows = [(draw.choice(texts), draw.choice(numbers), draw.choice(texts), draw.choice([0.5, None, float("nan")])) for _ in range(60)]
        if unique:
            rows = list({r[:2]: r for r in rows}.values())
        if wide:
            rows = [(k, None if n is None else float(n), t, v) for k, n, t, v in rows]
        return frame(f"k string, n {'double' if wide else 'long'}, t string, v double", *rows).drop("row_id")

    return side(False), side(True)


@pytest.mark.parametrize("options", [{}, {"ignore_case": True, "ignore_whitespace": True}])
@pytest.mark.parametrize("keys", [["k"], ["k", "n"], ["n"]])
def test_counts_without_pairs(frame, options, keys):
    for seed in range(3):
        master, second = random_sides(frame, seed)
        pairs = compare.compare_tables(master, second, keys, **options)
        counted = compare.compare_counts(master, second, keys, **options)
        expected = compare.compare_summary(pairs, keys)
        assert counted.dtypes == expected.dtypes and counted.first() == expected.first()
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
    nothing = compare.compare_counts(master.limit(0), second.limit(0), keys).first()
    assert tuple(nothing)[3:] == (0, 0, 0, 0)


def test_pruned_comparison_gives_the_differences(frame, rows):
    for seed in range(3):
        master, second = random_sides(frame, seed, unique=True)
        for keys in (["k", "n"],):
            found = compare.compare_pruned(master, second, keys)
            expected = compare.compare_tables(master, second, keys).where("status <> 'unchanged'")
            assert found.dtypes == expected.dtypes and list(map(str, rows(found))) == list(map(str, rows(expected)))
    # Which of two columns is null is a difference.
    one, other = (frame("k long, a string, b string", *r).drop("row_id") for r in ([(1, "x", None)], [(1, None, "x")]))
    assert rows(compare.compare_pruned(one, other, ["k"]), "status") == [("modified",)]
    assert compare.compare_pruned(one, one, ["k"]).isEmpty() and compare.compare_pruned(one.limit(0), one.limit(0), ["k"]).isEmpty()


def test_equal_buckets_are_not_joined(spark, monkeypatch):
    master = spark.range(20_000).selectExpr("id AS k", "id % 10 AS v")
    second = master.withColumn("v", F.when(F.col("k") == 7, 99).otherwise(F.col("v"))).where("k <> 11").unionAll(
        spark.range(1).selectExpr("20011L AS k", "0L AS v")
    )
    joined = []
    plain = compare.compare_tables
    monkeypatch.setattr(
        compare, "compare_tables", lambda a, b, *args, **more: joined.extend((a.count(), b.count())) or plain(a, b, *args, **more)
    )
    found = {(r.k, r.status) for r in compare.compare_pruned(master, second, ["k"]).collect()}
    assert found == {(7, "modified"), (11, "missing_in_second"), (20011, "new_in_second")}
    assert max(joined) < 20


def test_repeated_keys_of_equal_rows_are_unchanged(frame, rows):
    df = frame("k long, v string", (1, "a"), (1, "b"), (2, "c")).drop("row_id")
    assert compare.compare_pruned(df, df, ["k"]).isEmpty()
    changed = frame("k long, v string", (1, "a"), (1, "z"), (2, "c")).drop("row_id")
    assert {r.k for r in compare.compare_pruned(df, changed, ["k"]).collect()} == {1}
