"""Events that arrive as files: streams that are started again from their checkpoint, and an index that grows."""

from tallyframe.operators.search_index import search_indexed, update_index
from tallyframe.session import shared_folder
from tallyframe.streaming.folder import write_stream
from tallyframe.streaming.keyed import first_per_session, split_unique
from tallyframe_queries.inputs import table

KEYS = ["user_id", "event_type"]
LOTS = ["ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'"]
GAP_HOURS = 48
SHOWN = ["event_id", "user_id", "event_type", "value"]


def arrived(spark, folder, keyed):
    """What ``keyed`` gives of the stream until the last lot has been read: sessions closed by then."""
    events, files = table(spark, folder, "events"), shared_folder(spark, "events")
    found, state = shared_folder(spark, "found"), shared_folder(spark, "state")
    for lot in LOTS:
        events.where(lot).write.mode("append").parquet(files)
        stream = spark.readStream.schema(events.schema).parquet(files)
        write_stream(keyed(stream), found, state).awaitTermination()
    return spark.read.parquet(found)


def sessions(rows):
    return first_per_session(rows, KEYS, "ts", ["event_id"], f"{GAP_HOURS} hours", "1 hour")


def stream_keep_first(spark, folder):
    return arrived(spark, folder, sessions).select(*SHOWN, "session_rows")


def stream_unique(spark, folder):
    good = arrived(spark, folder, lambda rows: split_unique(rows, KEYS, "ts", ["event_id"], f"{GAP_HOURS} hours", "1 hour")[0])
    return good.select(*SHOWN)


def sessions_of_table(spark, folder):
    return sessions(table(spark, folder, "events")).select(*SHOWN, "session_rows")


def search_by_index(spark, folder):
    """Events in order of time, in eight files a lot; only files of the wanted day pass the index."""
    events, files, kept = table(spark, folder, "events"), shared_folder(spark, "events"), shared_folder(spark, "index")
    for lot in LOTS:
        events.where(lot).repartitionByRange(8, "ts").write.mode("append").parquet(files)
        update_index(spark, kept, files, ["ts", "event_type", "props"])
    return search_indexed(spark, kept, files, DAY).select(*SHOWN)


DAY = "2024-01-15"
SESSIONS = f"""WITH e AS (SELECT *, ts - lag(ts) OVER k > INTERVAL {GAP_HOURS} HOURS AS apart FROM events
WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
n AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING) AS session FROM e),
s AS (SELECT event_id, user_id, event_type, value,
row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY ts, event_id) AS place,
count(*) OVER (PARTITION BY user_id, event_type, session) AS session_rows,
max(ts) OVER (PARTITION BY user_id, event_type, session) + INTERVAL {GAP_HOURS} HOURS
<= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR AS closed FROM n)"""

QUERIES = {
    "stream_keep_first": (
        stream_keep_first, f"{SESSIONS} SELECT {', '.join(SHOWN)}, session_rows FROM s WHERE place = 1 AND closed",
    ),
    "stream_unique": (
        stream_unique, f"{SESSIONS} SELECT {', '.join(SHOWN)} FROM s WHERE session_rows = 1 AND closed",
    ),
    "search_indexed": (
        search_by_index,
        f"SELECT {', '.join(SHOWN)} FROM events WHERE contains(CAST(ts AS VARCHAR), '{DAY}')"
        f" OR contains(lower(event_type), '{DAY}') OR contains(lower(props), '{DAY}')",
    ),
    "first_per_session": (
        sessions_of_table, f"{SESSIONS} SELECT {', '.join(SHOWN)}, session_rows FROM s WHERE place = 1",
    ),
}
