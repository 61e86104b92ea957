from tallyframe.operators.lookup import lookup_and_copy, lookup_report
from tallyframe_queries.inputs import table, view, with_views

CUSTOMERS = ("customer", ["c_custkey AS custkey", "c_name", "c_mktsegment AS label"])
# Customers place many orders; the first order per customer is the master row.
ORDERS = (
    "orders",
    ["o_custkey + 5 AS custkey", "o_orderkey", "nullif(o_orderpriority, '5-LOW') AS label", "o_totalprice"],
)
FIRST_ORDERS = "(SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY o_orderkey) = 1)"


def lookup(copied, **options):
    def run(spark, folder):
        target, master = view(spark, folder, CUSTOMERS), view(spark, folder, ORDERS)
        return lookup_and_copy(target, master, "custkey", copied, "o_orderkey", **options)

    return run


def customers_sql(columns):
    return with_views(
        f"SELECT c.custkey, c.c_name, {columns} FROM c LEFT JOIN {FIRST_ORDERS} f ON c.custkey = f.custkey",
        c=CUSTOMERS, o=ORDERS,
    )


EVENTS = ("events", ["event_id", "nullif(user_id, 7) AS user_id", "nullif(event_type, 'error') AS event_type"])
EVENT_VALUES = (
    "events",
    ["event_id", "nullif(user_id, 7) AS user_id", "nullif(event_type, 'error') AS event_type", "value AS first_value"],
)


def composite(spark, folder):
    return lookup_and_copy(
        view(spark, folder, EVENTS), view(spark, folder, EVENT_VALUES),
        ["user_id", "event_type"], ["first_value"], "event_id",
    )


SHOUTED = ("customer", ["concat('  ', upper(c_name), ' ') AS name", "c_custkey"])
NAMES = ("customer", ["c_name AS name", "c_custkey AS custkey", "c_acctbal AS balance"])


def ignore_case(spark, folder):
    return lookup_and_copy(
        view(spark, folder, SHOUTED), view(spark, folder, NAMES), "name", ["balance"], "custkey",
        ignore_case=True, ignore_whitespace=True, matched="found",
    )


def report(spark, folder):
    return lookup_report(view(spark, folder, CUSTOMERS), view(spark, folder, ORDERS), "custkey")


def lineitem_lookup(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey AS p_partkey", "l_quantity"
    )
    return lookup_and_copy(
        lines, table(spark, folder, "part"), "p_partkey", ["p_name", "p_brand"], "p_partkey"
    )


QUERIES = {
    "lookup_copy": (
        lookup(["o_totalprice", "o_orderkey"]),
        customers_sql("c.label, f.o_totalprice, f.o_orderkey"),
    ),
    "lookup_overwrite": (
        lookup(["label"]),
        customers_sql("CASE WHEN f.custkey IS NOT NULL THEN f.label ELSE c.label END AS label"),
    ),
    "lookup_keep_existing": (
        lookup(["label"], overwrite_existing=False),
        customers_sql("c.label, f.label AS label_copied"),
    ),
    "lookup_composite": (
        composite,
        with_views(
            "SELECT e.event_id, e.user_id, e.event_type, f.first_value FROM e LEFT JOIN"
            " (SELECT * FROM v QUALIFY row_number() OVER"
            " (PARTITION BY user_id, event_type ORDER BY event_id) = 1) f"
            " ON coalesce(e.user_id, -1) = coalesce(f.user_id, -1)"
            " AND coalesce(e.event_type, '') = coalesce(f.event_type, '')",
            e=EVENTS, v=EVENT_VALUES,
        ),
    ),
    "lookup_ignore_case": (
        ignore_case,
        with_views(
            "SELECT t.name, t.c_custkey, m.balance, m.name IS NOT NULL AS found FROM t"
            " LEFT JOIN m ON lower(trim(t.name)) = lower(trim(m.name))",
            t=SHOUTED, m=NAMES,
        ),
    ),
    "lookup_report": (
        report,
        with_views(
            "SELECT 'custkey' AS match_column, count(*) FILTER (hit) AS matched,"
            " count(*) FILTER (NOT hit) AS unmatched FROM"
            " (SELECT custkey IN (SELECT custkey FROM o) AS hit FROM c)",
            c=CUSTOMERS, o=ORDERS,
        ),
    ),
    "lookup_lineitem": (
        lineitem_lookup,
        "SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, l_quantity, p_name, p_brand"
        " FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    ),
}
