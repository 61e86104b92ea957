from functools import reduce

from pyspark.sql import functions as F

from tallyframe.operators import combine, compare
from tallyframe.sources.reports import comparison_tables
from tallyframe_queries.inputs import ORDERS, ORDERS_LATER, sql, table, view, with_views

KEY = ["o_orderkey"]

MODIFIED = (
    "(m.o_custkey IS DISTINCT FROM s.o_custkey OR m.o_orderstatus IS DISTINCT FROM s.o_orderstatus"
    " OR m.o_totalprice IS DISTINCT FROM s.o_totalprice"
    " OR m.o_orderpriority IS DISTINCT FROM s.o_orderpriority)"
)
STATUS = (
    "CASE WHEN s.o_orderkey IS NULL THEN 'missing_in_second' WHEN m.o_orderkey IS NULL THEN"
    f" 'new_in_second' WHEN {MODIFIED} THEN 'modified' ELSE 'unchanged' END"
)
CHANGED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN m.{c} IS DISTINCT FROM s.{c} THEN '{c}' END"
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
) + ")"
PAIRS = "FROM m FULL OUTER JOIN s ON m.o_orderkey = s.o_orderkey"


def orders_sql(body):
    return with_views(body, m=ORDERS, s=ORDERS_LATER)


def both(spark, folder):
    return view(spark, folder, ORDERS), view(spark, folder, ORDERS_LATER)


def compared(spark, folder):
    return compare.compare_tables(*both(spark, folder), KEY)


def status(spark, folder):
    return compared(spark, folder).select(
        "o_orderkey", "status", "o_orderstatus_master", "o_orderstatus_second",
        "o_totalprice_master", "o_totalprice_second",
    )


def changed_columns(spark, folder):
    rows = compared(spark, folder).where("status = 'modified'")
    return rows.select("o_orderkey", F.array_join("changed_columns", ",").alias("changed"))


def modified(spark, folder):
    return compared(spark, folder).where("status = 'modified'").drop("changed_columns")


def missing(spark, folder):
    master, second = both(spark, folder)
    return compare.rows_missing(master, second, KEY)


def new(spark, folder):
    master, second = both(spark, folder)
    return compare.rows_missing(second, master, KEY)


def summary(spark, folder):
    return compare.compare_summary(compared(spark, folder), KEY, "orders", "later")


def report_summary(spark, folder):
    return comparison_tables(*both(spark, folder), KEY, "orders", "later")["summary"]


def counts(spark, folder):
    return compare.compare_counts(*both(spark, folder), KEY, "orders", "later")


def pruned(spark, folder):
    """Only rows that differ; most orders of the later state are the same."""
    master, second = both(spark, folder)
    rows = compare.compare_pruned(master, second.where("o_orderkey % 4 <> 1").unionAll(master.where("o_orderkey % 4 = 1")), KEY)
    return rows.select("o_orderkey", "status", F.array_join("changed_columns", ",").alias("changed"), "o_totalprice_second")


# A key with a third of the rows on both sides, and equal rows among them.
LINES = ("lineitem", ["CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS part", "l_linenumber AS line", "l_returnflag AS flag"])
ORDERED = ("orders", ["CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS part", "o_custkey % 7 AS line", "o_orderstatus AS flag"])


def factorised(spark, folder):
    return compare.compare_counts(view(spark, folder, LINES), view(spark, folder, ORDERED), ["part"])


def joins_counted(spark, folder):
    sides = view(spark, folder, LINES), view(spark, folder, ORDERED).withColumnRenamed("flag", "status")
    reports = [combine.count_joined(*sides, ["part", "line"], mode) for mode in ("inner", "left", "right", "outer")]
    return reduce(lambda a, b: a.unionAll(b), reports)


NAMES = ("customer", ["c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance"])
NAMES_SHOUTED = (
    "customer",
    [
        "concat('  ', upper(c_name), ' ') AS name",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS segment",
        "c_acctbal AS balance",
    ],
)


def ignore_case(spark, folder):
    pairs = compare.compare_tables(
        view(spark, folder, NAMES), view(spark, folder, NAMES_SHOUTED), ["name"],
        ignore_case=True, ignore_whitespace=True,
    )
    return pairs.select("name", "status", "segment_master", "segment_second")


NATION_OF_CUSTOMER = (
    "customer", ["nullif(c_nationkey, 3) AS nationkey", "c_custkey", "c_mktsegment AS label"],
)
NATIONS = ("nation", ["nullif(n_nationkey, 3) AS nationkey", "n_name AS label"])


def null_keys(spark, folder):
    pairs = compare.compare_tables(
        view(spark, folder, NATION_OF_CUSTOMER), view(spark, folder, NATIONS), ["nationkey"]
    )
    return pairs.select("nationkey", "c_custkey", "status", "label_master", "label_second")


# The same figures as whole numbers and as doubles: nothing has changed.
WHOLE = ("orders", ["o_orderkey", "o_custkey"])
FLOATING = ("orders", ["CAST(o_orderkey AS DOUBLE) AS o_orderkey", "CAST(o_custkey AS DOUBLE) AS o_custkey"])


def mixed_types(spark, folder):
    pairs = compare.compare_tables(view(spark, folder, WHOLE), view(spark, folder, FLOATING), KEY)
    return compare.compare_summary(pairs, KEY)


SUMMARY = (
    "SELECT count(*) FILTER (m.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL) AS matched,"
    " count(*) FILTER (s.o_orderkey IS NULL) AS missing_in_second,"
    " count(*) FILTER (m.o_orderkey IS NULL) AS new_in_second,"
    f" count(*) FILTER (m.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND {MODIFIED}) AS modified"
    f" {PAIRS}"
)

FACTORS = (
    "l AS (SELECT part, line, flag, count(*) AS n FROM ({}) GROUP BY ALL), o AS (SELECT part, line, flag, count(*) AS m"
    " FROM ({}) GROUP BY ALL)"
).format(sql(LINES), sql(ORDERED))
JOINED = f"({sql(LINES)}) a {{}} JOIN ({sql(ORDERED)}) b ON a.part = b.part AND a.line = b.line"

QUERIES = {
    "compare_counts": (
        counts, orders_sql(f"SELECT 'orders' AS master, 'later' AS second, 'o_orderkey' AS key_columns, * FROM ({SUMMARY})"),
    ),
    "compare_summary_factorised": (
        factorised,
        f"WITH {FACTORS}, k AS (SELECT part, sum(n) AS n FROM l GROUP BY part), j AS (SELECT part, sum(m) AS m FROM o"
        " GROUP BY part), e AS (SELECT coalesce(sum(n * m), 0) AS same FROM l JOIN o USING (part, line, flag))"
        " SELECT 'master' AS master, 'second' AS second, 'part' AS key_columns, CAST(sum(n * m) AS BIGINT) AS matched,"
        " CAST(coalesce(sum(n) FILTER (m IS NULL), 0) AS BIGINT) AS missing_in_second,"
        " CAST(coalesce(sum(m) FILTER (n IS NULL), 0) AS BIGINT) AS new_in_second,"
        " CAST(sum(n * m) - (SELECT same FROM e) AS BIGINT) AS modified FROM k FULL JOIN j USING (part)",
    ),
    "compare_pruned": (
        pruned,
        f"WITH m AS ({sql(ORDERS)}), l AS ({sql(ORDERS_LATER)}), s AS (SELECT * FROM l WHERE o_orderkey % 4 <> 1 UNION ALL"
        f" SELECT * FROM m WHERE o_orderkey % 4 = 1) SELECT coalesce(m.o_orderkey, s.o_orderkey) AS o_orderkey,"
        f" {STATUS} AS status, CASE WHEN m.o_orderkey IS NULL OR s.o_orderkey IS NULL THEN '' ELSE {CHANGED} END AS changed,"
        f" s.o_totalprice AS o_totalprice_second {PAIRS} WHERE {STATUS} <> 'unchanged'",
    ),
    "join_counts": (
        joins_counted,
        " UNION ALL ".join(
            f"SELECT '{mode}' AS mode, 'part, line' AS key_columns, 2::BIGINT AS source_count, count(*) AS result_rows,"
            f" 4::BIGINT AS result_columns FROM {JOINED.format(mode if mode != 'outer' else 'FULL')}"
            for mode in ("inner", "left", "right", "outer")
        ),
    ),
    "compare_status": (
        status,
        orders_sql(
            f"SELECT coalesce(m.o_orderkey, s.o_orderkey) AS o_orderkey, {STATUS} AS status,"
            " m.o_orderstatus AS o_orderstatus_master, s.o_orderstatus AS o_orderstatus_second,"
            " m.o_totalprice AS o_totalprice_master, s.o_totalprice AS o_totalprice_second"
            f" {PAIRS}"
        ),
    ),
    "compare_changed_columns": (
        changed_columns,
        orders_sql(
            f"SELECT m.o_orderkey, {CHANGED} AS changed FROM m JOIN s ON m.o_orderkey = s.o_orderkey"
            f" WHERE {MODIFIED}"
        ),
    ),
    "compare_modified": (
        modified,
        orders_sql(
            "SELECT m.o_orderkey, 'modified' AS status, "
            + ", ".join(
                f"m.{c} AS {c}_master, s.{c} AS {c}_second"
                for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
            )
            + f" FROM m JOIN s ON m.o_orderkey = s.o_orderkey WHERE {MODIFIED}"
        ),
    ),
    "compare_missing": (
        missing,
        orders_sql("SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = m.o_orderkey)"),
    ),
    "compare_new": (
        new,
        orders_sql("SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE s.o_orderkey = m.o_orderkey)"),
    ),
    "compare_summary": (
        summary,
        orders_sql(
            "SELECT 'orders' AS master, 'later' AS second, 'o_orderkey' AS key_columns, x.*"
            f" FROM ({SUMMARY}) x"
        ),
    ),
    "compare_report_summary": (
        report_summary,
        orders_sql(
            f", x AS ({SUMMARY}) SELECT 'Master File' AS \"Metric\", 'orders' AS \"Value\""
            " UNION ALL SELECT 'Second File', 'later' UNION ALL SELECT 'Key Column(s)', 'o_orderkey'"
            " UNION ALL SELECT 'Matched Rows', CAST(matched AS VARCHAR) FROM x"
            " UNION ALL SELECT 'Missing In Second', CAST(missing_in_second AS VARCHAR) FROM x"
            " UNION ALL SELECT 'New In Second', CAST(new_in_second AS VARCHAR) FROM x"
            " UNION ALL SELECT 'Modified Rows', CAST(modified AS VARCHAR) FROM x"
        ),
    ),
    "compare_ignore_case": (
        ignore_case,
        with_views(
            "SELECT coalesce(m.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'missing_in_second'"
            " WHEN m.name IS NULL THEN 'new_in_second' WHEN m.segment IS DISTINCT FROM s.segment OR"
            " m.balance IS DISTINCT FROM s.balance THEN 'modified' ELSE 'unchanged' END AS status,"
            " m.segment AS segment_master, s.segment AS segment_second"
            " FROM m FULL OUTER JOIN s ON lower(trim(m.name)) = lower(trim(s.name))",
            m=NAMES, s=NAMES_SHOUTED,
        ),
    ),
    "compare_null_keys": (
        null_keys,
        with_views(
            "SELECT coalesce(m.nationkey, s.nationkey) AS nationkey, m.c_custkey,"
            " CASE WHEN s.label IS NULL THEN 'missing_in_second' WHEN m.label IS NULL THEN"
            " 'new_in_second' WHEN m.label <> s.label THEN 'modified' ELSE 'unchanged' END AS status,"
            " m.label AS label_master, s.label AS label_second"
            " FROM m FULL OUTER JOIN s ON coalesce(m.nationkey, -1) = coalesce(s.nationkey, -1)",
            m=NATION_OF_CUSTOMER, s=NATIONS,
        ),
    ),
    "compare_mixed_types": (
        mixed_types,
        "SELECT 'master' AS master, 'second' AS second, 'o_orderkey' AS key_columns,"
        " count(*) AS matched, CAST(0 AS BIGINT) AS missing_in_second,"
        " CAST(0 AS BIGINT) AS new_in_second, CAST(0 AS BIGINT) AS modified FROM orders",
    ),
}
