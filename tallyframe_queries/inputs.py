"""Inputs the queries share: driver tables and views with nulls and dirty texts.

The driver tables hold no nulls and no bad values. The views put some in through
expressions that read the same in Spark SQL and in the checking SQL; every view
keeps all rows of its table.
"""


def table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def view(spark, folder, definition):
    name, expressions = definition
    return table(spark, folder, name).selectExpr(*expressions)


def sql(definition):
    name, expressions = definition
    return f"SELECT {', '.join(expressions)} FROM {name}"


def with_views(body, **definitions):
    """``body`` with the views as common table expressions."""
    heads = [f"{name} AS ({sql(definition)})" for name, definition in definitions.items()]
    return f"WITH {', '.join(heads)} {body}"


# Some event types are missing.
EVENTS_NULLS = (
    "events",
    ["event_id", "nullif(event_type, 'error') AS event_type", "nullif(user_id, 7) AS user_id", "value"],
)

# Numbers and dates as texts of good and bad form, and some negative amounts.
EVENTS_DIRTY = (
    "events",
    [
        "event_id",
        "nullif(user_id, 7) AS user_id",
        "event_type",
        "CASE event_type WHEN 'error' THEN 'n/a'"
        " WHEN 'click' THEN concat(' ', CAST(event_id AS STRING), ' ')"
        " WHEN 'view' THEN concat(CAST(event_id AS STRING), 'd')"
        " WHEN 'purchase' THEN concat('-', CAST(event_id AS STRING), '.5') END AS qty_text",
        "CASE event_type WHEN 'error' THEN 'not-a-date' WHEN 'click' THEN '2024-02-30'"
        " WHEN 'view' THEN '2024' ELSE substr(CAST(ts AS STRING), 1, 19) END AS when_text",
        "CASE WHEN event_type = 'signup' THEN -value ELSE value END AS amount",
        "props",
    ],
)

ORDERS = (
    "orders",
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
)

# A later state of the orders: some renumbered, some with a new price or no status.
ORDERS_LATER = (
    "orders",
    [
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"
        " THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey",
        "o_custkey",
        "nullif(o_orderstatus, 'F') AS o_orderstatus",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice",
        "o_orderpriority",
    ],
)

CUSTOMER_NULLS = (
    "customer",
    [
        "c_custkey",
        "c_name",
        "nullif(c_nationkey, 7) AS c_nationkey",
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal",
        "nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment",
    ],
)
