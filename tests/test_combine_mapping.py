import pytest

from tallyframe.functions.local import local_table
from tallyframe.operators import combine, mapping, search
from tallyframe.plans import specs


BOATS = [(3, "sloop"), (5, "ketch"), (5, "yawl"), (None, "raft"), (8, "canoe"), (13, None)]
BERTHS = [(5, "pier"), (8, "quay"), (8, "mole"), (21, "buoy"), (None, "beach")]


@pytest.fixture
def harbour(spark):
    return local_table(spark, BOATS, "length long, boat string"), local_table(spark, BERTHS, "length int, berth string")


def joined_by_hand(mode):
    out = [(a, boat, berth) for a, boat in BOATS for b, berth in BERTHS if a == b]
    if mode in ("left", "outer"):
        out += [(a, boat, None) for a, boat in BOATS if a not in [b for b, _ in BERTHS]]
    if mode in ("right", "outer"):
        out += [(b, None, berth) for b, berth in BERTHS if b not in [a for a, _ in BOATS]]
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["inner", "left", "right", "outer"])
def test_join_modes(harbour, mode):
    joined = combine.join_tables(*harbour, ["length"], mode)
    assert joined.columns == ["length", "boat", "berth"]
    assert sorted((tuple(r) for r in joined.collect()), key=str) == joined_by_hand(mode)
    report = combine.join_report(joined, mode, ["length"]).first()
    assert tuple(report) == (mode, "length", 2, len(joined_by_hand(mode)), 3)


def test_join_errors(harbour):
    for keys, mode in ((["length"], "sideways"), ([], "inner"), (["boat"], "inner")):
        with pytest.raises(ValueError):
            combine.join_tables(*harbour, keys, mode)


def test_join_names_must_differ(spark):
    a = local_table(spark, [(1, 2, 3)], "k long, v long, V_right long")
    b = local_table(spark, [(1, 2)], "k long, v long")
    with pytest.raises(ValueError, match="one name"):
        combine.join_tables(a, b, ["k"], "inner")


def test_overlapping_columns_and_null_keys(spark, rows):
    a = local_table(spark, [("x", None, 1), ("y", 1, 2)], "v string, k long, only_a long")
    b = local_table(spark, [(None, "p"), (1, "q")], "k int, v string")
    joined = combine.join_tables(a, b, ["k"], "inner")
    assert joined.columns == ["v_left", "k", "only_a", "v_right"]
    assert rows(joined) == [("x", None, 1, "p"), ("y", 1, 2, "q")]


def test_union_aligns_and_tags(spark, rows):
    a = local_table(spark, [(4, "dry"), (None, "wet"), (4, "dry")], "depth long, ground string")
    b = local_table(spark, [("mud", 9, True)], "ground string, depth long, mapped boolean")
    union = combine.union_tables([a, b], ["spring.csv", "fall.csv"])
    assert rows(union, "depth", "ground", "mapped", "Source File") == [
        (None, "wet", None, "spring.csv"), (4, "dry", None, "spring.csv"), (4, "dry", None, "spring.csv"),
        (9, "mud", True, "fall.csv"),
    ]


def test_union_widens_types(spark, rows):
    a = local_table(spark, [(1, 1, True)], "n int, c long, d boolean")
    b = local_table(spark, [(0.5, "x", None)], "n double, c string, d string")
    union = combine.union_tables([a, b], ["a", "b"])
    assert [t for _, t in union.dtypes] == ["double", "string", "string", "string"]
    assert rows(union, "n", "c", "d") == [(0.5, "x", None), (1.0, "1", "true")]


def test_union_overwrites_its_tag_column(spark):
    a = local_table(spark, [("old",)], "`Source File` string")
    assert combine.union_tables([a], ["new"]).first()[0] == "new"


def test_union_errors(spark):
    with pytest.raises(ValueError):
        combine.union_tables([], [])
    with pytest.raises(ValueError):
        combine.union_tables([spark.range(1)], ["a", "b"])


def test_consolidate(spark, rows):
    header = "river string, gauge double"
    parts = {
        ("n.xlsx", "May"): [("rhine", 3.5), ("ems", None)], ("n.xlsx", "June"): [], ("s.xlsx", "May"): [("inn", 1.0)] * 2,
    }
    listed = [("odd.xlsx", "May", local_table(spark, [("x",)], "lake string"))]
    listed += [(file, sheet, local_table(spark, data, header)) for (file, sheet), data in parts.items()]
    merged = combine.consolidate(listed, "2031-05-01T06:00:00")
    expected = [(*row, *source, "2031-05-01T06:00:00") for source, data in parts.items() for row in data]
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(expected, key=str)
    assert tuple(combine.consolidation_summary(spark, listed, merged).first()) == (2, 0, 4, 3, 1)
    report = combine.consolidation_report(spark, listed, merged)
    assert rows(report, "source_file", "source_sheet", "consolidated", "rows") == [
        ("n.xlsx", "June", True, 0), ("n.xlsx", "May", True, 2), ("odd.xlsx", "May", False, None), ("s.xlsx", "May", True, 2),
    ]
    with pytest.raises(ValueError):
        combine.consolidate([], "2031-05-01")


def test_header_groups_look_at_order_and_first_seen(spark):
    ab = local_table(spark, [(1, 2)], "a long, b long")
    ba = local_table(spark, [(1, 2)], "b long, a long")
    groups = combine.header_groups([("1", "s", ba), ("2", "s", ab)])
    assert [columns for columns, _ in groups] == [("b", "a"), ("a", "b")]


def test_map_columns(spark):
    df = local_table(spark, [("p", 1, 2.0)], "herb string, bed long, yield double")
    pairs = specs.mappings_from(
        [{"source": "yield", "destination": "kilos per bed"}, {"source": "herb", "destination": "plant"}]
    )
    assert mapping.map_columns(df, pairs).columns == ["kilos per bed", "plant"]
    kept = mapping.map_columns(df, [("bed", "row")], keep_unmapped=True)
    assert kept.columns == ["row", "herb", "yield"]
    assert tuple(kept.first()) == (1, "p", 2.0)


def test_mapping_errors(spark):
    df = local_table(spark, [(1, 2)], "bed long, yield long")
    for pairs in ([], [("soil", "x")], [("bed", "x"), ("bed", "y")], [("bed", "x"), ("yield", "x")]):
        with pytest.raises(ValueError):
            mapping.map_columns(df, pairs)
    with pytest.raises(ValueError):
        mapping.map_columns(df, [("bed", "yield")], keep_unmapped=True)


def test_identical_names():
    pairs = mapping.map_identical_names(["herb", "Bed", "yield", "soil"], ["yield", "bed", "herb", "rain"])
    assert pairs == [("herb", "herb"), ("yield", "yield")]


def test_search_takes_text_literally_and_ignores_case(spark, rows):
    df = local_table(spark, [(1, "50% OFF", 1.5), (2, None, 50.0), (3, "x", None)], "id long, t string, n double")
    assert rows(search.search_rows(df, "% off"), "id") == [(1,)]
    assert rows(search.search_rows(df, "50"), "id") == [(1,), (2,)]
    assert search.search_rows(df, "").count() == 3
    assert tuple(search.search_counts(df, "5").first()) == (2, 3)
    assert rows(search.search_rows(df, "x", ["n"]), "id") == []


def test_sort_is_typed_and_puts_blanks_lowest(spark):
    df = local_table(spark, [(1, 10), (2, 9), (3, None), (4, 10)], "id long, v long")
    assert [r.id for r in search.sort_rows(df, "v", then_by=["id"]).collect()] == [3, 2, 1, 4]
    assert [r.id for r in search.sort_rows(df, "v", False, ["id"]).collect()] == [1, 4, 2, 3]
    assert [r.id for r in search.sort_rows(df, "v", False, ["id"], limit=2).collect()] == [1, 4]


def test_mark_blanks(spark, rows):
    df = local_table(spark, [(None, 1.0), ("", float("nan"))], "a string, b double")
    assert rows(search.mark_blanks(df), "a_is_blank", "b_is_blank") == [(False, True), (True, False)]


@pytest.mark.parametrize("mode", ["inner", "left", "right", "outer"])
def test_joined_rows_are_counted_without_a_join(frame, mode):
    left = frame("k string, n long, a long", *[("x", 1, 1)] * 5, ("y", 1, 2), (None, 2, 3), (None, 2, 4), ("z", None, 5)).drop("row_id")
    right = frame("n double, k string, a long", (1.0, "x", 1), (1.0, "x", 1), (2.0, None, 2), (7.0, "q", 3), (float("nan"), "z", 4)).drop("row_id")
    counted = combine.count_joined(left, right, ["k", "n"], mode)
    expected = combine.join_report(combine.join_tables(left, right, ["k", "n"], mode), mode, ["k", "n"])
    assert counted.dtypes == expected.dtypes and counted.first() == expected.first()
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
    assert combine.count_joined(left.limit(0), right.limit(0), ["k"], mode).first().result_rows == 0
