"""Workflows, the audit log, file round trips and snapshots."""

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from tallyframe.operators import audit
from tallyframe.plans.specs import workflow_from
from tallyframe.plans.workflow import (
    run_tagged, run_workflow, run_workflow_batch, run_workflow_folder,
)
from tallyframe.session import shared_folder
from tallyframe.sources import delimited, reports, snapshots
from tallyframe.sources.consolidation import consolidate_folder
from tallyframe.sources.files import POSITION
from tallyframe.sources.parquet import read_parquet
from tallyframe_queries.inputs import CUSTOMER_NULLS, sql, table, view, with_views

NOW = datetime(2024, 1, 31)

_, EVENT_STEPS = workflow_from(
    {
        "name": "Latest events",
        "steps": [
            {
                "step_type": "remove_duplicates",
                "parameters": {"columns": ["user_id", "event_type"], "keep": "highest"},
            },
            {
                "step_type": "validate",
                "parameters": {"rules": [{"rule_type": "custom_expression", "parameter": "value >= 50"}]},
            },
            {
                "step_type": "column_map",
                "parameters": {
                    "mappings": [
                        {"source_column": "user_id", "destination_column": "User"},
                        {"source_column": "value", "destination_column": "Value"},
                    ]
                },
            },
        ],
    }
)


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "event_type", "user_id", "value")


def chain(spark, folder):
    return run_workflow(events(spark, folder), EVENT_STEPS, "event_id")[0]


def chain_steps(spark, folder):
    return run_workflow(events(spark, folder), EVENT_STEPS, "event_id")[1].select(
        "step_no", "step_type", "success", "detail"
    )


def tagged(spark, folder):
    return run_tagged(events(spark, folder), EVENT_STEPS, "event_id", "event_type")[0]


def tagged_report(spark, folder):
    report = run_tagged(events(spark, folder), EVENT_STEPS, "event_id", "event_type")[1]
    return reports.batch_run_table(report)


def one_pass(spark, folder):
    """The result and the report of one pass, as rows of one table."""
    result, report = run_tagged(events(spark, folder), EVENT_STEPS, "event_id", "event_type", one_pass=True)
    told = report.select(F.col("source").alias("event_type"), "rows_before", "rows_after", "detail")
    return result.unionByName(told, allowMissingColumns=True)


def one_pass_batch(spark, folder):
    """Sources of one header, with a unique rule that begins a new pass: results and report."""
    sources = [("customer.csv", view(spark, folder, PARTY)), ("supplier.csv", view(spark, folder, PARTY_SUPPLIER))]
    (result,), report = run_workflow_batch(sources, PARTY_STEPS, "id", source="source", one_pass=True)
    return result.unionByName(report.select("source", "rows_before", "rows_after", "detail"), allowMissingColumns=True)


PARTY = ("customer", ["c_custkey AS id", "c_nationkey AS nation", "c_acctbal AS balance"])
PARTY_SUPPLIER = ("supplier", ["s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS balance"])
OTHER = ("part", ["p_partkey AS id", "p_brand AS brand"])

_, PARTY_STEPS = workflow_from(
    {
        "steps": [
            {"step_type": "remove_duplicates", "parameters": {"columns": ["nation"], "keep": "last"}},
            {
                "step_type": "validate",
                "parameters": {
                    "rules": [
                        {"rule_type": "no_negative", "column": "balance"},
                        {"rule_type": "unique", "column": "nation"},
                    ]
                },
            },
        ]
    }
)


def batch(spark, folder):
    sources = [
        ("customer.csv", view(spark, folder, PARTY)),
        ("part.csv", view(spark, folder, OTHER)),
        ("supplier.csv", view(spark, folder, PARTY_SUPPLIER)),
    ]
    return run_workflow_batch(sources, PARTY_STEPS, "id", source="source")


def batch_result(spark, folder):
    return batch(spark, folder)[0][0]


def batch_report(spark, folder):
    return batch(spark, folder)[1].where("status = 'OK'")


def batch_failures(spark, folder):
    return batch(spark, folder)[1].where("status <> 'OK'").drop("detail")


BEST = "row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) = 1"
KEPT = f"SELECT event_id, event_type, user_id, value FROM events QUALIFY {BEST}"

LOG = (
    "events",
    [
        "event_id AS id",
        "ts AS timestamp",
        "concat('user', CAST(user_id AS STRING)) AS file_key",
        "event_type AS sheet_name",
        "props AS operation",
    ],
)


# Some entries have no time.
UNDATED = ("events", [LOG[1][0], "CASE WHEN event_id % 5 <> 0 THEN ts END AS timestamp", *LOG[1][2:]])


def audit_search(spark, folder):
    return audit.query_entries(view(spark, folder, LOG), "K\": 4")


def audit_count(spark, folder):
    return audit.count_entries(view(spark, folder, LOG))


def audit_prune(spark, folder):
    return audit.prune_entries(view(spark, folder, UNDATED), 10, NOW)[0]


def audit_prune_count(spark, folder):
    return audit.prune_entries(view(spark, folder, UNDATED), 10, NOW)[1]


def audit_export(spark, folder):
    return audit.audit_export(view(spark, folder, LOG))


def audit_append(spark, folder):
    """Entries appended in two runs and read back."""
    path = shared_folder(spark, "audit")
    for number, name in enumerate(("nation", "region")):
        rows = table(spark, folder, name).orderBy(f"{name[0]}_{name}key").collect()
        entries = [(f"{name}.csv", "Sheet1", row[1]) for row in rows]
        audit.append_entries(spark, path, entries, datetime(2024, 1, 30 + number))
    return spark.read.parquet(path).select("id", "timestamp", "file_key", "sheet_name", "operation")


def audit_append_events(spark, folder):
    """Entries of all events, appended in two runs."""
    path = shared_folder(spark, "audit-log")
    entries = view(spark, folder, LOG).select("file_key", "sheet_name", "operation", F.col("id").alias("event_id"))
    for number, part in enumerate(("event_id % 3 = 0", "event_id % 3 <> 0")):
        audit.append_log(spark, path, entries.where(part), datetime(2024, 1, 30 + number), ["event_id"])
    return audit.read_log(spark, path)


def delimited_customers(spark, folder):
    """Customers with nulls, written as csv and read back with inferred types."""
    path = shared_folder(spark, "customers") + ".csv"
    reports.write_table(view(spark, folder, CUSTOMER_NULLS), path, "csv")
    return delimited.read_delimited(spark, path).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


def delimited_documents(spark, folder):
    """Whole texts with quotes and line breaks, written as csv and read back."""
    path = shared_folder(spark, "documents") + ".csv"
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang")
    reports.write_table(rows, path, "csv")
    return delimited.read_delimited(spark, path).select("doc_id", "text", "lang")


def exported(spark, folder):
    """A folder with csv files of three tables, two of which share a header."""
    path = shared_folder(spark, "exports")
    for definition in (PARTY, PARTY_SUPPLIER, OTHER):
        view(spark, folder, definition).write.mode("append").option("header", True).csv(path)
    return path


def folder_log(spark, folder):
    """Rows per header group."""
    _, log = delimited.read_folder(spark, exported(spark, folder))
    return (
        log.where("status = 'ok'")
        .groupBy(F.array_join("header", ", ").alias("columns"))
        .agg(F.sum("rows").alias("rows"))
    )


def folder_tables(spark, folder):
    """All rows of the files with the parties' header."""
    tables, _ = delimited.read_folder(spark, exported(spark, folder))
    parties = [df for header, df in tables if "balance" in header]
    return reduce(lambda a, b: a.unionByName(b), parties).select("id", "nation", "balance")


def folder_consolidated(spark, folder):
    stamped, _ = consolidate_folder(spark, exported(spark, folder), "2024-01-31T00:00:00")
    return stamped.drop("__source_file__")


FILE_RULES = [
    {"rule_type": "no_negative", "column": "balance"},
    {"rule_type": "unique", "column": "id"},
]
_, FILE_STEPS = workflow_from(
    {
        "steps": [
            {"step_type": "remove_duplicates", "parameters": {"columns": ["id"]}},
            {"step_type": "validate", "parameters": {"rules": FILE_RULES}},
        ]
    }
)


def folder_workflow(spark, folder):
    """Every file as a source of its own; sums over the files, whose number varies."""
    _, report = run_workflow_folder(spark, exported(spark, folder), FILE_STEPS)
    issues = F.regexp_extract("detail", r"validate: (\d+) issue", 1).try_cast("bigint")
    return report.groupBy("status").agg(
        F.sum("rows_before").alias("rows_before"),
        F.sum("rows_after").alias("rows_after"),
        F.sum(issues).alias("issues"),
    )


def parquet_row_ids(spark, folder):
    orders = read_parquet(spark, f"{folder}/orders.parquet", positions=True)
    return orders.select("o_orderkey", F.col(POSITION).alias("row_id"))


def snapshot_restored(spark, folder):
    path = shared_folder(spark, "snapshots")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    nations = table(spark, folder, "nation")
    snapshots.snapshot_tables([("old.csv", "Sheet1", "old", nations)], path, datetime(2024, 1, 1))
    snapshots.snapshot_tables(
        [("orders.csv", "Sheet1", "orders", orders), ("nation.csv", "Sheet1", "nation", nations)],
        path,
        NOW,
    )
    return snapshots.restore_tables(spark, path)["orders.csv", "Sheet1"]


PARTIES = f"SELECT *, 'customer.csv' AS source FROM ({sql(PARTY)}) UNION ALL" \
    f" SELECT *, 'supplier.csv' FROM ({sql(PARTY_SUPPLIER)})"
LAST_OF_NATION = f"SELECT * FROM ({PARTIES}) QUALIFY row_number() OVER" \
    " (PARTITION BY source, nation ORDER BY id DESC) = 1"

QUERIES = {
    "workflow_chain": (chain, f'SELECT user_id AS "User", value AS "Value" FROM ({KEPT})'),
    "workflow_chain_steps": (
        chain_steps,
        f"WITH k AS ({KEPT}), n AS (SELECT count(*) AS after, (SELECT count(*) FROM events) AS before,"
        " count(*) FILTER (value < 50) AS issues FROM k)"
        " SELECT 0 AS step_no, 'remove_duplicates' AS step_type, true AS success,"
        " concat('Removed ', CAST(before - after AS VARCHAR), ' row(s)') AS detail FROM n"
        " UNION ALL SELECT 1, 'validate', issues = 0,"
        " concat(CAST(issues AS VARCHAR), ' issue(s) found') FROM n"
        " UNION ALL SELECT 2, 'column_map', true, 'Result has 2 column(s)'",
    ),
    "workflow_tagged": (
        tagged, f'SELECT user_id AS "User", value AS "Value", event_type FROM ({KEPT})',
    ),
    "workflow_tagged_report": (
        tagged_report,
        f"WITH k AS ({KEPT}), n AS (SELECT event_type, count(*) AS after,"
        " count(*) FILTER (value < 50) AS issues FROM k GROUP BY event_type),"
        " b AS (SELECT event_type, count(*) AS before FROM events GROUP BY event_type)"
        ' SELECT event_type AS "Source", before AS "Rows Before", after AS "Rows After",'
        " 'OK' AS \"Status\", concat('remove_duplicates: Removed ', CAST(before - after AS VARCHAR),"
        " ' row(s); validate: ', CAST(issues AS VARCHAR), ' issue(s) found; column_map: Result has"
        " 2 column(s)') AS \"Detail\" FROM b JOIN n USING (event_type)",
    ),
    "workflow_one_pass": (
        one_pass,
        f"WITH k AS ({KEPT}), n AS (SELECT event_type, count(*) AS after, count(*) FILTER (value < 50) AS issues"
        " FROM k GROUP BY event_type), b AS (SELECT event_type, count(*) AS before FROM events GROUP BY event_type)"
        ' SELECT user_id AS "User", value AS "Value", event_type, NULL::BIGINT AS rows_before, NULL::BIGINT AS rows_after,'
        " NULL::VARCHAR AS detail FROM k UNION ALL SELECT NULL, NULL, event_type, before, after,"
        " concat('remove_duplicates: Removed ', CAST(before - after AS VARCHAR), ' row(s); validate: ',"
        " CAST(issues AS VARCHAR), ' issue(s) found; column_map: Result has 2 column(s)') FROM b JOIN n USING (event_type)",
    ),
    "workflow_one_pass_batch": (
        one_pass_batch,
        f"WITH p AS ({PARTIES}), k AS ({LAST_OF_NATION}), n AS (SELECT source, count(*) AS after,"
        " count(*) FILTER (balance < 0) AS issues FROM k GROUP BY source),"
        " b AS (SELECT source, count(*) AS before FROM p GROUP BY source)"
        " SELECT id, nation, balance, source, NULL::BIGINT AS rows_before, NULL::BIGINT AS rows_after,"
        " NULL::VARCHAR AS detail FROM k UNION ALL SELECT NULL, NULL, NULL, source, before, after,"
        " concat('remove_duplicates: Removed ', CAST(before - after AS VARCHAR), ' row(s); validate: ',"
        " CAST(issues AS VARCHAR), ' issue(s) found') FROM b JOIN n USING (source)",
    ),
    "workflow_batch": (batch_result, LAST_OF_NATION),
    "workflow_batch_report": (
        batch_report,
        f"WITH p AS ({PARTIES}), k AS ({LAST_OF_NATION}), n AS (SELECT source, count(*) AS after,"
        " count(*) FILTER (balance < 0) AS issues FROM k GROUP BY source),"
        " b AS (SELECT source, count(*) AS before FROM p GROUP BY source)"
        " SELECT source, before AS rows_before, after AS rows_after, 'OK' AS status,"
        " concat('remove_duplicates: Removed ', CAST(before - after AS VARCHAR), ' row(s); validate: ',"
        " CAST(issues AS VARCHAR), ' issue(s) found') AS detail FROM b JOIN n USING (source)",
    ),
    "workflow_batch_failures": (
        batch_failures,
        "SELECT 'part.csv' AS source, count(*) AS rows_before, count(*) AS rows_after,"
        " 'FAILED_STEP' AS status FROM part",
    ),
    "audit_search": (
        audit_search,
        with_views(
            "SELECT * FROM l WHERE contains(lower(operation), 'k\": 4') OR contains(file_key, 'k\": 4')"
            " OR contains(sheet_name, 'k\": 4')",
            l=LOG,
        ),
    ),
    "audit_count": (audit_count, "SELECT count(*) AS entries FROM events"),
    "audit_prune": (
        audit_prune,
        with_views(
            "SELECT * FROM l WHERE timestamp IS NULL OR timestamp >= TIMESTAMP '2024-01-21 00:00:00'",
            l=UNDATED,
        ),
    ),
    "audit_prune_count": (
        audit_prune_count,
        "SELECT count(*) FILTER (event_id % 5 <> 0 AND ts < TIMESTAMP '2024-01-21 00:00:00') AS removed FROM events",
    ),
    "audit_export": (
        audit_export,
        with_views(
            'SELECT timestamp AS "Timestamp", file_key AS "File", sheet_name AS "Sheet",'
            ' operation AS "Operation" FROM l',
            l=LOG,
        ),
    ),
    "audit_append": (
        audit_append,
        "SELECT n_nationkey + 1 AS id, '2024-01-30T00:00:00' AS timestamp, 'nation.csv' AS file_key,"
        " 'Sheet1' AS sheet_name, n_name AS operation FROM nation UNION ALL"
        " SELECT r_regionkey + 26, '2024-01-31T00:00:00', 'region.csv', 'Sheet1', r_name FROM region",
    ),
    "audit_append_events": (
        audit_append_events,
        with_views(
            "SELECT row_number() OVER (ORDER BY CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END, id) AS id, CASE WHEN id % 3 = 0"
            " THEN '2024-01-30T00:00:00' ELSE '2024-01-31T00:00:00' END AS timestamp, file_key, sheet_name, operation FROM l",
            l=LOG,
        ),
    ),
    "read_delimited": (
        delimited_customers,
        with_views(
            "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,"
            " c_mktsegment FROM c",
            c=CUSTOMER_NULLS,
        ),
    ),
    "read_delimited_texts": (delimited_documents, "SELECT doc_id, text, lang FROM documents"),
    "read_folder_log": (
        folder_log,
        "SELECT 'id, nation, balance' AS columns, (SELECT count(*) FROM customer)"
        " + (SELECT count(*) FROM supplier) AS rows UNION ALL SELECT 'id, brand', count(*) FROM part",
    ),
    "read_folder": (
        folder_tables,
        "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance"
        " FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
    ),
    "consolidate_folder": (
        folder_consolidated,
        f"SELECT id, CAST(nation AS BIGINT) AS nation, balance, 'Sheet1' AS __source_sheet__,"
        f" '2024-01-31T00:00:00' AS __import_timestamp__ FROM ({PARTIES})",
    ),
    "workflow_folder": (
        folder_workflow,
        "SELECT 'OK' AS status, count(*) AS rows_before, count(*) AS rows_after,"
        f" count(*) FILTER (balance < 0) AS issues FROM ({PARTIES}) UNION ALL"
        " SELECT 'FAILED_STEP', count(*), count(*), NULL FROM part",
    ),
    "parquet_row_ids": (parquet_row_ids, "SELECT o_orderkey, o_orderkey AS row_id FROM orders"),
    "snapshot_restore": (
        snapshot_restored, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    ),
}
