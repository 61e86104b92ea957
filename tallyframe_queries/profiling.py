from pyspark.sql import functions as F

from tallyframe.operators import profile
from tallyframe.operators.profile_state import (
    DISTINCT_ERROR, file_states, merged_profile, merged_quantiles, update_profile,
)
from tallyframe.session import shared_folder
from tallyframe.sources.reports import profile_tables
from tallyframe_queries.inputs import CUSTOMER_NULLS, table, view, with_views

CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint", True),
    ("c_name", "string", False),
    ("c_nationkey", "int", True),
    ("c_acctbal", "double", True),
    ("c_mktsegment", "string", False),
]
ORDER_COLUMNS = [
    ("o_orderkey", "bigint", True),
    ("o_custkey", "bigint", True),
    ("o_orderstatus", "string", False),
    ("o_orderpriority", "string", False),
]
LINE_COLUMNS = [
    ("l_orderkey", "bigint", True),
    ("l_partkey", "bigint", True),
    ("l_suppkey", "bigint", True),
    ("l_linenumber", "int", True),
    ("l_quantity", "double", True),
    ("l_extendedprice", "double", True),
    ("l_returnflag", "string", False),
]


def column_sql(n, name, dtype, numeric, source):
    low, high = (f"CAST({f}({name}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    text = f"length(CAST({name} AS VARCHAR))"
    return (
        f"SELECT {n} AS ordinal, '{name}' AS column, '{dtype}' AS dtype, count(*) AS row_count,"
        f" count(*) - count({name}) AS null_count,"
        f" round_even(100.0 * (count(*) - count({name})) / count(*), 2) AS null_pct,"
        f" count(DISTINCT {name}) AS unique_count,"
        f" round_even(100.0 * count(DISTINCT {name}) / count(*), 2) AS unique_pct,"
        f" round_even(100.0 * (count({name}) - count(DISTINCT {name})) / count(*), 2) AS duplicate_pct,"
        f" min({text}) AS min_length, max({text}) AS max_length,"
        f" {low} AS min_value, {high} AS max_value, {str(numeric).lower()} AS is_numeric FROM {source}"
    )


def profile_sql(columns, source):
    return " UNION ALL ".join(column_sql(n, *c, source) for n, c in enumerate(columns))


def examples_sql(columns, count):
    """First ``count`` distinct texts among the first 200 filled cells, per column."""
    return " UNION ALL ".join(
        f"SELECT {n} AS ordinal, '{name}' AS column, (SELECT string_agg(v, ', ' ORDER BY place) FROM"
        f" (SELECT v, min(place) AS place FROM (SELECT CAST({name} AS VARCHAR) AS v,"
        f" row_number() OVER (ORDER BY c_custkey) AS place FROM c WHERE {name} IS NOT NULL)"
        f" WHERE place <= 200 GROUP BY v ORDER BY place LIMIT {count})) AS examples"
        for n, (name, *_) in enumerate(columns)
    )


def customers(spark, folder):
    return view(spark, folder, CUSTOMER_NULLS)


def profiled(name, columns):
    def run(spark, folder):
        bare = table(spark, folder, name)
        return profile.profile_columns(bare, [c[0] for c in columns], per_column=True)

    return run


def profile_customers(spark, folder):
    return profile.profile_columns(customers(spark, folder))


def profile_approx(spark, folder):
    return profile.profile_columns_approx(customers(spark, folder))


def examples(spark, folder):
    found = profile.example_values(
        customers(spark, folder), "c_custkey", [c[0] for c in CUSTOMER_COLUMNS]
    )
    return found.withColumn("examples", F.array_join("examples", ", "))


def statistics(spark, folder):
    return profile.column_statistics(customers(spark, folder), "c_custkey")


def null_shares(spark, folder):
    return profile.null_shares(customers(spark, folder))


DOCUMENT_SHAPE = ("documents", ["nullif(lang, 'fr') AS lang", "nullif(source, 'src1') AS source", "text"])


def metadata(spark, folder):
    return profile.table_metadata(view(spark, folder, DOCUMENT_SHAPE))


def summary_table(spark, folder):
    return profile_tables(customers(spark, folder), "c_custkey")["summary"]


# Orders of one status have none.
ORDERS_PROFILED = (
    "orders",
    ["o_orderkey", "o_custkey", "nullif(o_orderstatus, 'P') AS o_orderstatus", "o_totalprice", "o_orderpriority"],
)
PROFILED_COLUMNS = [
    ("o_orderkey", "bigint", True),
    ("o_custkey", "bigint", True),
    ("o_orderstatus", "string", False),
    ("o_totalprice", "double", True),
    ("o_orderpriority", "string", False),
]


def arriving_orders(spark, folder):
    """``orders, states``: the orders as files that came in two lots, profiled after each."""
    orders = view(spark, folder, ORDERS_PROFILED)
    arrived, kept = shared_folder(spark, "orders"), shared_folder(spark, "profile")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    for lot in (~urgent, urgent):
        orders.where(lot).write.mode("append").parquet(arrived)
        update_profile(spark, kept, arrived)
    return spark.read.parquet(arrived), file_states(spark, kept)


def profile_merged(spark, folder):
    """Figures merged from the states of files, and whether distinct counts are within three standard errors."""
    orders, states = arriving_orders(spark, folder)
    exact = profile.profile_columns(orders).select("ordinal", F.col("unique_count").alias("exact"))
    far = F.abs(F.col("unique_count") - F.col("exact"))
    near = far <= F.greatest(F.lit(1), 3 * DISTINCT_ERROR * F.col("exact"))
    found = merged_profile(states).join(exact, "ordinal").withColumn("unique_near", near)
    return found.drop("exact", "unique_count", "unique_pct", "duplicate_pct")


def profile_merged_quantiles(spark, folder):
    """Whether merged quartiles of the prices lie at their share of the rows, by two in a hundred."""
    orders, states = arriving_orders(spark, folder)
    found = merged_quantiles(states).where("column = 'o_totalprice'")
    prices = orders.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("o_totalprice").alias("column"), "o_totalprice", "n"
    )
    beside = prices.join(F.broadcast(found), "column")
    price, rows = F.col("o_totalprice"), F.sum("n")
    checks = [
        (F.sum(F.when(price < F.col("quantiles")[i], F.col("n")).otherwise(0)) <= (share + 0.02) * rows)
        & (F.sum(F.when(price <= F.col("quantiles")[i], F.col("n")).otherwise(0)) >= (share - 0.02) * rows)
        for i, share in enumerate((0.25, 0.5, 0.75))
    ]
    return beside.groupBy("column").agg(
        *[check.alias(f"{name}_near") for check, name in zip(checks, ("lower", "median", "upper"))],
        rows.alias("row_count"),
    )


QUERIES = {
    "profile_columns": (
        profile_customers, with_views(profile_sql(CUSTOMER_COLUMNS, "c"), c=CUSTOMER_NULLS),
    ),
    "profile_orders": (profiled("orders", ORDER_COLUMNS), profile_sql(ORDER_COLUMNS, "orders")),
    "profile_lineitem": (profiled("lineitem", LINE_COLUMNS), profile_sql(LINE_COLUMNS, "lineitem")),
    "profile_approx": (profile_approx, None),
    "profile_merged": (
        profile_merged,
        with_views(
            "SELECT * EXCLUDE (unique_count, unique_pct, duplicate_pct), true AS unique_near"
            f" FROM ({profile_sql(PROFILED_COLUMNS, 'o')})",
            o=ORDERS_PROFILED,
        ),
    ),
    "profile_merged_quantiles": (
        profile_merged_quantiles,
        "SELECT 'o_totalprice' AS column, true AS lower_near, true AS median_near, true AS upper_near,"
        " count(*) AS row_count FROM orders",
    ),
    "profile_examples": (
        examples, with_views(examples_sql(CUSTOMER_COLUMNS, 5), c=CUSTOMER_NULLS),
    ),
    "column_statistics": (
        statistics,
        with_views(
            'SELECT p.ordinal, p.column AS "Column", p.dtype AS "Type", p.null_pct AS "Null %",'
            ' p.unique_pct AS "Unique %", p.duplicate_pct AS "Duplicate %", p.min_value AS "Min",'
            ' p.max_value AS "Max", x.examples AS "Example Values"'
            f" FROM ({profile_sql(CUSTOMER_COLUMNS, 'c')}) p JOIN"
            f" ({examples_sql(CUSTOMER_COLUMNS, 3)}) x ON p.ordinal = x.ordinal",
            c=CUSTOMER_NULLS,
        ),
    ),
    "null_shares": (
        null_shares,
        with_views(
            f'SELECT ordinal, "column", null_pct FROM ({profile_sql(CUSTOMER_COLUMNS, "c")})',
            c=CUSTOMER_NULLS,
        ),
    ),
    "table_metadata": (
        metadata,
        with_views(
            "SELECT count(*) AS row_count, CAST(3 AS BIGINT) AS column_count,"
            " count(*) - count(DISTINCT (lang, source, text)) AS duplicate_rows,"
            " 3 * count(*) - count(lang) - count(source) - count(text) AS blank_cells,"
            " round_even(100.0 * (count(lang) + count(source) + count(text)) / (3 * count(*)), 1)"
            " AS fill_rate_pct FROM d",
            d=DOCUMENT_SHAPE,
        ),
    ),
    "profile_summary": (
        summary_table,
        with_views(
            ", s AS (SELECT count(*) AS n, 5 * count(*) - count(c_custkey) - count(c_name)"
            " - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS blanks FROM c)"
            " SELECT 'Row Count' AS \"Metric\", CAST(n AS VARCHAR) AS \"Value\" FROM s"
            " UNION ALL SELECT 'Column Count', '5' UNION ALL SELECT 'Duplicate Rows', '0'"
            " UNION ALL SELECT 'Blank Cells', CAST(blanks AS VARCHAR) FROM s"
            " UNION ALL SELECT 'Fill Rate', CAST(round_even(100.0 * (5 * n - blanks) / (5 * n), 1)"
            " AS VARCHAR) FROM s",
            c=CUSTOMER_NULLS,
        ),
    ),
}
