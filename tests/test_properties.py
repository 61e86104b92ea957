"""Random small tables against straightforward Python."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.functions.local import local_table
from tallyframe.operators import compare, dedupe, rules
from tallyframe.operators.lookup import lookup_and_copy
from tallyframe.operators.skew import skew_join

KEY = st.sampled_from([None, 1, 2, 3, 4])
TABLE = st.lists(st.tuples(KEY, st.sampled_from([None, 1, 2, 3])), min_size=1, max_size=25)
FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def build(spark, table, names="id long, k long, v long"):
    return local_table(spark, [(i, *row) for i, row in enumerate(table)], names)


@FEW
@given(TABLE, st.sampled_from(["first", "last", "highest"]))
def test_kept_rows(spark, table, keep):
    df = build(spark, table)
    groups = {}
    for i, (k, v) in enumerate(table):
        groups.setdefault(k, []).append((i, v))
    best = {
        "first": lambda g: g[0][0],
        "last": lambda g: g[-1][0],
        "highest": lambda g: max(g, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))[0],
    }[keep]
    expected = {best(g) for g in groups.values()}
    assert {r.id for r in dedupe.drop_duplicates(df, "k", "id", keep).collect()} == expected
    flagged = dedupe.mark_duplicates(df, "k", "id", keep).collect()
    assert {r.id for r in flagged if not r.is_duplicate} == expected and len(flagged) == len(table)


@FEW
@given(TABLE, TABLE)
def test_compare_counts(spark, left, right):
    pairs = compare.compare_tables(
        build(spark, left).drop("id"), build(spark, right).drop("id"), ["k"], min_hot_rows=3
    )
    counted = Counter(r.status for r in pairs.collect())
    lk, rk = Counter(k for k, _ in left), Counter(k for k, _ in right)
    matched = sum(n * rk[k] for k, n in lk.items())
    same = sum(1 for k, v in left for k2, v2 in right if (k, v) == (k2, v2))
    assert counted["missing_in_second"] == sum(n for k, n in lk.items() if k not in rk)
    assert counted["new_in_second"] == sum(n for k, n in rk.items() if k not in lk)
    assert counted["unchanged"] == same and counted["modified"] == matched - same


@FEW
@given(TABLE, TABLE, st.sampled_from(["inner", "left", "right", "full_outer"]))
def test_skew_join_is_a_join(spark, left, right, mode):
    a = build(spark, left, "lid long, k long, lv long")
    b = build(spark, right, "rid long, k long, rv long")
    joined = skew_join(a, b, ["k"], mode, min_hot_rows=2, buckets=4)
    got = Counter((r.lid, r.rid) for r in joined.collect())
    want = Counter((i, j) for i, (k, _) in enumerate(left) for j, (k2, _) in enumerate(right) if k == k2)
    met_left, met_right = {i for i, _ in want}, {j for _, j in want}
    if mode in ("left", "full_outer"):
        want.update((i, None) for i in range(len(left)) if i not in met_left)
    if mode in ("right", "full_outer"):
        want.update((None, j) for j in range(len(right)) if j not in met_right)
    assert got == want


@FEW
@given(TABLE, TABLE)
def test_lookup_keeps_every_target_row(spark, target, master):
    found = lookup_and_copy(
        build(spark, target), build(spark, master, "at long, k long, copied long"), "k", ["copied"], "at"
    ).collect()
    first = {}
    for k, v in master:
        first.setdefault(k, v)
    assert {r.id: r.copied for r in found} == {i: first.get(k) for i, (k, _) in enumerate(target)}
    assert len(found) == len(target)


@FEW
@given(TABLE)
def test_good_and_bad_rows_add_up(spark, table):
    df = build(spark, table)
    checks = [rules.Rule("required", "v"), rules.Rule("unique", "k"), rules.Rule("custom_expression", None, "v > 1")]
    good, bad = rules.split_rows(df, checks)
    assert good.count() + bad.count() == len(table)
    issues = rules.validate(df, checks, "id").count()
    assert issues == sum(len(r.issues) for r in bad.collect())
    assert issues == rules.validation_report(df, checks).first().issues_found
