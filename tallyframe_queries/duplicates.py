from tallyframe.operators import dedupe
from tallyframe.sources.reports import duplicate_tables
from tallyframe_queries.inputs import EVENTS_NULLS, table, view, with_views

KEYS = ["user_id", "event_type"]
SHOWN = ["event_id", "user_id", "event_type", "value"]
FIRST = "PARTITION BY user_id, event_type ORDER BY event_id"
LAST = "PARTITION BY user_id, event_type ORDER BY event_id DESC"
HIGHEST = "PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id"

# lineitem rows have no id; rows equal in all these columns are copies of each other.
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]


def events(spark, folder):
    return table(spark, folder, "events").select(*SHOWN)


def mask(keep):
    return lambda spark, folder: dedupe.mark_duplicates(events(spark, folder), KEYS, "event_id", keep)


def mask_sql(window, source="events"):
    return (
        "SELECT event_id, user_id, event_type, value,"
        f" row_number() OVER ({window}) > 1 AS is_duplicate FROM {source}"
    )


def deduped(keep):
    return lambda spark, folder: dedupe.drop_duplicates(events(spark, folder), KEYS, "event_id", keep)


def deduped_sql(window, sign="= 1"):
    return (
        "SELECT event_id, user_id, event_type, value FROM events"
        f" QUALIFY row_number() OVER ({window}) {sign}"
    )


def mask_null_keys(spark, folder):
    return dedupe.mark_duplicates(view(spark, folder, EVENTS_NULLS), KEYS, "event_id")


def lineitem_dedupe(spark, folder):
    lines = table(spark, folder, "lineitem")
    kept = dedupe.drop_duplicates(lines, LINE_KEYS, LINE_ORDER, "highest", "l_extendedprice")
    return kept.select(*LINE_KEYS, "l_partkey", "l_suppkey", "l_extendedprice")


def duplicate_rows(spark, folder):
    return dedupe.duplicate_rows(events(spark, folder), KEYS, "event_id")


def report(spark, folder):
    return dedupe.duplicate_report(events(spark, folder), KEYS)


def summary(spark, folder):
    return duplicate_tables(events(spark, folder), KEYS, "event_id")["summary"]


def full_rows(spark, folder):
    documents = table(spark, folder, "documents").select("text", "lang", "source")
    return dedupe.full_row_duplicates(documents)


COUNTS = (
    "SELECT count(*) AS total, count(*) - count(DISTINCT (user_id, event_type)) AS repeated FROM events"
)

QUERIES = {
    "dup_mask_first": (mask("first"), mask_sql(FIRST)),
    "dup_mask_last": (mask("last"), mask_sql(LAST)),
    "dup_mask_highest": (mask("highest"), mask_sql(HIGHEST)),
    "dup_mask_null_keys": (mask_null_keys, with_views(mask_sql(FIRST, "e"), e=EVENTS_NULLS)),
    "dedupe_first": (deduped("first"), deduped_sql(FIRST)),
    "dedupe_last": (deduped("last"), deduped_sql(LAST)),
    "dedupe_highest": (deduped("highest"), deduped_sql(HIGHEST)),
    "dedupe_lineitem": (
        lineitem_dedupe,
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem"
        " QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber"
        f" ORDER BY l_extendedprice DESC, {', '.join(LINE_ORDER)}) = 1",
    ),
    "dup_rows": (duplicate_rows, deduped_sql(FIRST, "> 1")),
    "dup_report": (
        report,
        "SELECT 'user_id, event_type' AS columns_checked, total AS total_rows,"
        " repeated AS duplicate_rows, round_even(100.0 * repeated / total, 1) AS duplicate_pct,"
        f" 'first' AS keep_strategy FROM ({COUNTS})",
    ),
    "dup_summary": (
        summary,
        f"WITH c AS ({COUNTS})"
        " SELECT 'Columns Checked' AS \"Metric\", 'user_id, event_type' AS \"Value\""
        " UNION ALL SELECT 'Total Rows', CAST(total AS VARCHAR) FROM c"
        " UNION ALL SELECT 'Duplicate Rows', CAST(repeated AS VARCHAR) FROM c"
        " UNION ALL SELECT 'Keep Strategy', 'first'",
    ),
    "full_row_dups": (
        full_rows,
        "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows"
        " FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)",
    ),
}
