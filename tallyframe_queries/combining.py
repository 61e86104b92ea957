from functools import reduce

from pyspark.sql import functions as F

from tallyframe.operators import combine
from tallyframe_queries.inputs import sql, view, with_views

CUSTOMERS = ("customer", ["c_custkey AS custkey", "c_mktsegment AS label", "c_name"])
ORDERS = ("orders", ["o_custkey + 5 AS custkey", "o_orderpriority AS label", "o_orderkey"])
NULL_NATIONS = ("nation", ["nullif(n_nationkey, 3) AS nationkey", "n_name"])
NULL_CUSTOMERS = ("customer", ["nullif(c_nationkey, 3) AS nationkey", "c_custkey"])


def join(mode):
    def run(spark, folder):
        left, right = view(spark, folder, CUSTOMERS), view(spark, folder, ORDERS)
        return combine.join_tables(left, right, ["custkey"], mode)

    return run


def join_sql(kind):
    return with_views(
        "SELECT coalesce(l.custkey, r.custkey) AS custkey, l.label AS label_left, l.c_name,"
        f" r.label AS label_right, r.o_orderkey FROM l {kind} JOIN r ON l.custkey = r.custkey",
        l=CUSTOMERS, r=ORDERS,
    )


def null_keys(spark, folder):
    left, right = view(spark, folder, NULL_CUSTOMERS), view(spark, folder, NULL_NATIONS)
    return combine.join_tables(left, right, ["nationkey"], "inner")


def report(spark, folder):
    return combine.join_report(join("outer")(spark, folder), "outer", ["custkey"])


CUSTOMER_LIST = (
    "customer", ["c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment"],
)
SUPPLIER_LIST = ("supplier", ["s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"])


def union(spark, folder):
    frames = [view(spark, folder, CUSTOMER_LIST), view(spark, folder, SUPPLIER_LIST)]
    return combine.union_tables(frames, ["customer", "supplier"])


NUMBER_CODES = ("customer", ["c_custkey AS code", "c_nationkey AS size"])
TEXT_CODES = ("part", ["p_brand AS code", "CAST(p_partkey AS DOUBLE) + 0.5 AS size"])


def union_widen(spark, folder):
    frames = [view(spark, folder, NUMBER_CODES), view(spark, folder, TEXT_CODES)]
    return combine.union_tables(frames, ["customer", "part"])


PARTY = ("customer", ["c_custkey AS id", "c_name AS name", "c_acctbal AS balance"])
PARTY_SUPPLIER = ("supplier", ["s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"])
OTHER = ("part", ["p_partkey AS id", "p_name AS name"])
STAMP = "2024-01-31T00:00:00"


def sources(spark, folder):
    return [
        ("part.csv", "Sheet1", view(spark, folder, OTHER)),
        ("customer.csv", "Sheet1", view(spark, folder, PARTY)),
        ("supplier.csv", "Sheet1", view(spark, folder, PARTY_SUPPLIER)),
    ]


def consolidated(spark, folder):
    return combine.consolidate(sources(spark, folder), STAMP)


def header_groups(spark, folder):
    """Per header group its sources and all their rows."""
    listed = sources(spark, folder)
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).withColumn("source_file", F.lit(file))
        for file, _, df in listed
    ]
    rows = reduce(lambda a, b: a.unionAll(b), counts)
    return combine.header_group_table(spark, listed).join(rows, "source_file").groupBy(
        F.col("group_index").cast("bigint").alias("group_index"), "columns"
    ).agg(F.count(F.lit(1)).alias("sources"), F.sum("rows").alias("rows"))


def consolidate_report(spark, folder):
    listed = sources(spark, folder)
    report = combine.consolidation_report(spark, listed, combine.consolidate(listed, STAMP))
    return report.withColumn("group_index", F.col("group_index").cast("bigint"))


def consolidate_summary(spark, folder):
    listed = sources(spark, folder)
    return combine.consolidation_summary(spark, listed, combine.consolidate(listed, STAMP))


STAMPED = (
    "SELECT *, '{}.csv' AS __source_file__, 'Sheet1' AS __source_sheet__,"
    f" '{STAMP}' AS __import_timestamp__ FROM ({{}})"
)

QUERIES = {
    **{
        f"join_{mode}": (join(mode), join_sql(kind))
        for mode, kind in
        {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL OUTER"}.items()
    },
    "join_null_keys": (
        null_keys,
        with_views(
            "SELECT l.nationkey, l.c_custkey, r.n_name FROM l JOIN r"
            " ON coalesce(l.nationkey, -1) = coalesce(r.nationkey, -1)",
            l=NULL_CUSTOMERS, r=NULL_NATIONS,
        ),
    ),
    "join_report": (
        report,
        f"SELECT 'outer' AS mode, 'custkey' AS key_columns, CAST(2 AS BIGINT) AS source_count,"
        f" count(*) AS result_rows, CAST(5 AS BIGINT) AS result_columns FROM ({join_sql('FULL OUTER')})",
    ),
    "union_by_name": (
        union,
        f"SELECT *, 'customer' AS \"Source File\" FROM ({sql(CUSTOMER_LIST)}) UNION ALL"
        f" SELECT *, NULL, 'supplier' FROM ({sql(SUPPLIER_LIST)})",
    ),
    "union_widen": (
        union_widen,
        "SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_nationkey AS DOUBLE) AS size,"
        " 'customer' AS \"Source File\" FROM customer UNION ALL"
        " SELECT p_brand, CAST(p_partkey AS DOUBLE) + 0.5, 'part' FROM part",
    ),
    "header_groups": (
        header_groups,
        "SELECT CAST(0 AS BIGINT) AS group_index, 'id, name, balance' AS columns,"
        " CAST(2 AS BIGINT) AS sources, (SELECT count(*) FROM customer)"
        " + (SELECT count(*) FROM supplier) AS rows UNION ALL"
        " SELECT 1, 'id, name', 1, count(*) FROM part",
    ),
    "consolidate": (
        consolidated,
        STAMPED.format("customer", sql(PARTY))
        + " UNION ALL " + STAMPED.format("supplier", sql(PARTY_SUPPLIER)),
    ),
    "consolidate_report": (
        consolidate_report,
        "SELECT CAST(0 AS BIGINT) AS group_index, 'id, name, balance' AS columns,"
        " 'customer.csv' AS source_file, 'Sheet1' AS source_sheet, true AS consolidated,"
        " count(*) AS rows FROM customer UNION ALL"
        " SELECT 0, 'id, name, balance', 'supplier.csv', 'Sheet1', true, count(*) FROM supplier"
        " UNION ALL SELECT 1, 'id, name', 'part.csv', 'Sheet1', false, NULL",
    ),
    "consolidate_summary": (
        consolidate_summary,
        "SELECT CAST(2 AS BIGINT) AS group_count, CAST(0 AS BIGINT) AS chosen_group_index,"
        " (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS consolidated_rows,"
        " CAST(2 AS BIGINT) AS consolidated_sources, CAST(1 AS BIGINT) AS mismatched_sources",
    ),
}
