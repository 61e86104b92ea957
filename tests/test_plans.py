"""Physical plans: what must and must not appear in them."""

import contextlib
import io
import re

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from tallyframe.operators import compare, dedupe, profile, rules, search
from tallyframe.operators.combine import join_tables

QUERIES = contract.queries()


def plan(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SMALL}/orders.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_global_windows(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    # Window functions, partition columns, order: two lists only mean no partition columns.
    for arguments in re.findall(r"^\(\d+\) Window *\n.*\nArguments: (.*)$", text, re.M):
        assert arguments.count("], [") == 2, arguments


def test_duplicates_are_dropped_before_the_shuffle(events):
    text = plan(dedupe.drop_duplicates(events, ["user_id"], "event_id"), "simple")
    partial, exchange, final = (text.index(s) for s in ("row_number(), 1, Final", "Exchange", "row_number(), 1, Partial"))
    assert partial < exchange < final


def test_the_mask_shuffles_rows_by_key_and_order(events):
    text = plan(dedupe.mark_duplicates(events, ["event_type"], "event_id"), "simple")
    assert "partial_min(event_id" in text
    assert "Window" not in text


def test_report_reads_only_the_key_columns(events):
    text = plan(dedupe.duplicate_report(events, ["user_id"]))
    assert re.findall(r"ReadSchema: (.*)", text) == ["struct<user_id:bigint>"]


def test_filters_reach_the_scan(events):
    text = plan(dedupe.duplicate_report(events.where("user_id = 3"), ["event_type"]))
    assert "EqualTo(user_id,3)" in text


def test_missing_rows_are_an_anti_join_on_keys_alone(orders):
    text = plan(compare.rows_missing(orders, orders, ["o_orderkey"]))
    assert "LeftAnti" in text
    assert "struct<o_orderkey:bigint>" in text


def test_null_safe_keys_stay_hashable(spark, orders):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(join_tables(orders, orders, ["o_custkey"], "outer"), "simple")
        assert "SortMergeJoin" in text and "FullOuter" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_rules_share_one_scan(events):
    checks = [rules.Rule("required", "user_id"), rules.Rule("no_negative", "value"), rules.Rule("regex", "props", "x")]
    text = plan(rules.validate(events, checks, "event_id"))
    assert text.count("ReadSchema") == 1 and "Exchange" not in text
    assert "ts:" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_profile_scans_once_or_one_column_at_a_time(orders):
    whole = plan(profile.profile_columns(orders, ["o_orderkey", "o_orderstatus"]))
    assert whole.count("ReadSchema") == 1
    each = plan(profile.profile_columns(orders, ["o_orderkey", "o_orderstatus"], per_column=True))
    schemas = set(re.findall(r"ReadSchema: (.*)", each))
    assert schemas == {"struct<o_orderkey:bigint>", "struct<o_orderstatus:string>"}


def test_top_rows_need_no_full_sort(orders):
    text = plan(search.sort_rows(orders, "o_totalprice", False, ["o_orderkey"], limit=5), "simple")
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
