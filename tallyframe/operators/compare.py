"""Reconcile two tables by key: missing, new, modified and unchanged rows.

Values are compared by type after widening, so ``30`` equals ``30.0`` and a null
never equals a text such as "None". Rows whose key occurs several times on both
sides are paired with each other, as in any equi-join.
"""

from pyspark.sql import functions as F

from tallyframe.errors import require_columns, require_distinct, require_some
from tallyframe.functions.columns import all_of, any_of, col, common_type, dtype_of, known, match_keys
from tallyframe.operators.skew import LEFT_TAG, RIGHT_TAG, skew_join

MISSING, NEW, MODIFIED, UNCHANGED = (
    "missing_in_second", "new_in_second", "modified", "unchanged",
)


def _check(master, second, keys):
    require_some(keys, "Comparing tables takes at least one key column.")
    require_columns(master, keys, "Master key column")
    require_columns(second, keys, "Second key column")


def _keyed(df, keys, prepared, prefix):
    return df.select(
        *[k.alias(f"__k{i}") for i, k in enumerate(prepared)],
        *[col(c).alias(f"{prefix}{i}") for i, c in enumerate(df.columns)],
    ), [f"__k{i}" for i in range(len(keys))]


def compare_tables(
    master, second, keys, *, ignore_case=False, ignore_whitespace=False, min_hot_rows=None
):
    """Every row pair with its ``status`` and, if modified, ``changed_columns``.

    Output: the keys (as written in the master, else in the second table),
    ``status``, ``changed_columns`` in master column order, ``<c>_master`` and
    ``<c>_second`` for columns both tables have, and all other columns by name.
    """
    _check(master, second, keys)
    left_keys, right_keys = match_keys(master, second, keys, ignore_case, ignore_whitespace)
    left, names = _keyed(master, keys, left_keys, "__m")
    right, _ = _keyed(second, keys, right_keys, "__s")
    pairs = skew_join(left, right, names, "full_outer", min_hot_rows=min_hot_rows)

    at_left = {c: F.col(f"__m{i}") for i, c in enumerate(master.columns)}
    at_right = {c: F.col(f"__s{i}") for i, c in enumerate(second.columns)}
    shared = [c for c in master.columns if c not in keys and c in second.columns]

    def differs(name):
        wide = common_type(dtype_of(master, name), dtype_of(second, name))
        a = known(at_left[name], dtype_of(master, name)).cast(wide)
        b = known(at_right[name], dtype_of(second, name)).cast(wide)
        return ~a.eqNullSafe(b)

    matched = F.col(LEFT_TAG) & F.col(RIGHT_TAG)
    differences = {c: differs(c) for c in shared}
    modified = any_of(differences.values()) if shared else F.lit(False)
    status = (
        F.when(F.col(RIGHT_TAG).isNull(), MISSING)
        .when(F.col(LEFT_TAG).isNull(), NEW)
        .when(modified, MODIFIED)
        .otherwise(UNCHANGED)
    )
    nothing = F.array().cast("array<string>")
    # One short array per differing column, joined: stays inside generated code.
    changed = [F.when(d, F.array(F.lit(c))).otherwise(nothing) for c, d in differences.items()]
    changed = F.concat(*changed) if shared else nothing
    key_columns = []
    for name in keys:
        wide = common_type(dtype_of(master, name), dtype_of(second, name))
        key_columns.append(
            F.when(F.col(LEFT_TAG), at_left[name].cast(wide)).otherwise(at_right[name].cast(wide)).alias(name)
        )
    rest = [c for t in (master, second) for c in t.columns if c not in keys and c not in shared]
    both = [f"{n}_{side}" for n in shared for side in ("master", "second")]
    require_distinct([*keys, "status", "changed_columns", *both, *rest])
    return pairs.select(
        *key_columns,
        status.alias("status"),
        F.when(matched, changed).otherwise(nothing).alias("changed_columns"),
        *[c for n in shared for c in (at_left[n].alias(f"{n}_master"), at_right[n].alias(f"{n}_second"))],
        *[at_left[c].alias(c) for c in master.columns if c not in keys and c not in shared],
        *[at_right[c].alias(c) for c in second.columns if c not in keys and c not in shared],
    )


def rows_missing(
    master, second, keys, *, ignore_case=False, ignore_whitespace=False, min_hot_rows=None
):
    """Master rows whose key the second table lacks; an anti join, no values compared.

    Swap the tables for the rows that are new in the second one.
    """
    _check(master, second, keys)
    left_keys, right_keys = match_keys(master, second, keys, ignore_case, ignore_whitespace)
    left, names = _keyed(master, keys, left_keys, "__m")
    right = second.select(*[k.alias(n) for k, n in zip(right_keys, names)])
    kept = skew_join(left, right, names, "left_anti", min_hot_rows=min_hot_rows)
    return kept.select(*[F.col(f"__m{i}").alias(c) for i, c in enumerate(master.columns)])


def _compared_values(master, second, keys, ignore_case, ignore_whitespace):
    """Both tables as ``__k<i>`` keys and ``__v<i>`` values that ``compare_tables`` would compare, of common types."""
    _check(master, second, keys)
    shared = [c for c in master.columns if c not in keys and c in second.columns]
    wide = [common_type(dtype_of(master, c), dtype_of(second, c)) for c in shared]
    sides = []
    for df, prepared in zip((master, second), match_keys(master, second, keys, ignore_case, ignore_whitespace)):
        values = [known(col(c), dtype_of(df, c)).cast(w).alias(f"__v{i}") for i, (c, w) in enumerate(zip(shared, wide))]
        sides.append(df.select(*[k.alias(f"__k{i}") for i, k in enumerate(prepared)], *values))
    return sides


def compare_counts(
    master, second, keys, master_label="master", second_label="second", *, ignore_case=False, ignore_whitespace=False
):
    """What ``compare_summary`` counts, without pairing any row.

    Equal rows are counted per side; a key with n and m rows has n x m pairs, of which those of equal rows are
    unchanged. Rows are combined before each of two shuffles, so a key may hold any share of them. An error
    if a count exceeds a bigint.
    """
    left, right = _compared_values(master, second, keys, ignore_case, ignore_whitespace)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = left.withColumns({"n": one, "m": none}).unionAll(right.withColumns({"n": none, "m": one}))
    names = [c for c in left.columns if c.startswith("__k")]
    equal = rows.groupBy(*left.columns).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    n, m = (F.col(c).cast("decimal(19,0)") for c in "nm")
    by_key = equal.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(n * m).alias("same"))

    def total(amount, condition=None):
        amount = amount if condition is None else F.when(condition, amount)
        return F.coalesce(F.sum(amount), F.lit(0)).cast("long")

    return by_key.agg(
        F.lit(master_label).alias("master"),
        F.lit(second_label).alias("second"),
        F.lit(", ".join(keys)).alias("key_columns"),
        total(n * m).alias("matched"),
        total(F.col("n"), F.col("m") == 0).alias("missing_in_second"),
        total(F.col("m"), F.col("n") == 0).alias("new_in_second"),
        total(n * m - F.col("same")).alias("modified"),
    )


BUCKETS, GROUPS = 65_536, 256


def _bucket(names):
    return F.pmod(F.xxhash64(*map(F.col, names)), F.lit(BUCKETS)).cast("int")


def _digests(rows):
    """``bucket, rows, h1, h2``: per bucket of keys the number of rows and two sums of row hashes, whatever their order."""
    # Hashes skip nulls, so which columns are null is hashed as well.
    blanks = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in rows.columns])
    hashes = [F.xxhash64(F.lit(seed), blanks, *map(F.col, rows.columns)).cast("decimal(38,0)") for seed in (1, 2)]
    names = [c for c in rows.columns if c.startswith("__k")]
    return rows.groupBy(_bucket(names).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes, 1)]
    )


def differing_buckets(left, right):
    """``bucket`` numbers in which two digest tables differ; groups of buckets are compared first."""
    group = F.floor(F.col("bucket") / (BUCKETS // GROUPS))
    sums = ("rows", "h1", "h2")

    def unequal(a, b, by):
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in sums]
        paired = a.alias("a").join(b.alias("b"), F.col(f"a.{by}") == F.col(f"b.{by}"), "full_outer")
        return paired.where(~all_of(same)).select(F.coalesce(f"a.{by}", f"b.{by}").alias(by))

    sides = [df.withColumn("group", group) for df in (left, right)]
    coarse = [df.groupBy("group").agg(*[F.sum(c).alias(c) for c in sums]) for df in sides]
    groups = unequal(*coarse, "group")
    return unequal(*[df.join(groups, "group", "left_semi") for df in sides], "bucket")


def compare_pruned(
    master, second, keys, *, ignore_case=False, ignore_whitespace=False, min_hot_rows=None
):
    """The rows of ``compare_tables`` that are not unchanged, from a join of differing rows' buckets alone.

    Keys are dealt to ``BUCKETS`` buckets by hash. A first job sums 128-bit hashes of the rows in each and compares
    the sums of both sides, those of groups of buckets first; the list of differing buckets, which is bounded, comes
    to the driver. Rows of other buckets are neither shuffled nor joined. A bucket whose rows are the same on
    both sides counts as unchanged, also where a key occurs several times in it.
    """
    sides = _compared_values(master, second, keys, ignore_case, ignore_whitespace)
    found = differing_buckets(*map(_digests, sides)).collect()
    # One byte per bucket, whatever the number that differ: a task looks its rows' buckets up.
    flags = bytearray(BUCKETS)
    for row in found:
        flags[row.bucket] = 1
    listed = F.lit(bytes(flags))
    kept = []
    for df, prepared in zip((master, second), match_keys(master, second, keys, ignore_case, ignore_whitespace)):
        names = [f"__b{i}" for i in range(len(keys))]
        bucketed = df.withColumns(dict(zip(names, prepared)))
        differs = F.substring(listed, _bucket(names) + 1, F.lit(1)) == F.lit(b"\x01")
        kept.append(bucketed.where(differs).drop(*names))
    pairs = compare_tables(
        *kept, keys, ignore_case=ignore_case, ignore_whitespace=ignore_whitespace, min_hot_rows=min_hot_rows
    )
    return pairs.where(F.col("status") != UNCHANGED)


def compare_summary(compared, keys, master_label="master", second_label="second"):
    """One row of counts from ``compare_tables`` output; matched includes modified."""

    def rows(*statuses):
        return F.count_if(F.col("status").isin(*statuses))

    return compared.agg(
        F.lit(master_label).alias("master"),
        F.lit(second_label).alias("second"),
        F.lit(", ".join(keys)).alias("key_columns"),
        rows(MODIFIED, UNCHANGED).alias("matched"),
        rows(MISSING).alias("missing_in_second"),
        rows(NEW).alias("new_in_second"),
        rows(MODIFIED).alias("modified"),
    )
