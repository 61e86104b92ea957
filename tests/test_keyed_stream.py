from datetime import datetime, timedelta

import pytest

from tallyframe.streaming import keyed
from tallyframe.streaming.folder import write_stream

START = datetime(2024, 3, 1)


def visits(frame, *rows):
    return frame(
        "gate string, at timestamp, badge double",
        *[(g, None if m is None else START + timedelta(minutes=m), b) for g, m, b in rows],
    )


def test_sessions_of_a_table(frame, rows):
    df = visits(
        frame, ("n", 0, 1.0), ("n", 20, 2.0), ("n", 90, 3.0), ("s", 5, 4.0), (None, 0, 5.0), (None, 1, 6.0), ("s", None, 7.0),
    )
    found = keyed.first_per_session(df, ["gate"], "at", ["row_id"], gap="30 minutes")
    assert found.columns == [*df.columns, "session_rows"]
    assert rows(found, "gate", "badge", "session_rows") == [(None, 5.0, 2), ("n", 1.0, 2), ("n", 3.0, 1), ("s", 4.0, 1)]
    good, repeated = keyed.split_unique(df, ["gate"], "at", ["row_id"], gap="30 minutes")
    assert rows(good, "badge") == [(3.0,), (4.0,)] and rows(repeated, "badge", "session_rows") == [(1.0, 2), (5.0, 2)]
    assert rows(keyed.rows_without_time(df, "at"), "badge") == [(7.0,)]


def test_ties_nan_and_empty(frame, rows):
    df = visits(frame, ("n", 0, float("nan")), ("n", 0, None), ("n", 0, 1.0))
    found = keyed.first_per_session(df, ["badge"], "at", ["row_id"])
    assert rows(found, "row_id", "session_rows") == [(0, 2), (2, 1)]
    assert keyed.first_per_session(df.where("false"), ["gate"], "at").isEmpty()


def test_errors(frame):
    df = visits(frame, ("n", 0, 1.0))
    for keys, at in (([], "at"), (["door"], "at"), (["gate"], "when")):
        with pytest.raises(ValueError):
            keyed.first_per_session(df, keys, at)
    with pytest.raises(ValueError):
        keyed.first_per_session(df.withColumnRenamed("badge", "session_rows"), ["gate"], "at")


def test_arriving_files_with_a_restart(spark, frame, rows, tmp_path):
    """Sessions go on over restarts, are given out once when closed, and rows behind the watermark are counted."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*new):
        df = visits(frame, *new).coalesce(1)
        df.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        found = keyed.first_per_session(stream, ["gate"], "at", ["badge"], gap="30 minutes", delay="10 minutes")
        query = write_stream(found, out, str(tmp_path / "state"))
        query.awaitTermination()
        return keyed.rows_too_late(query), rows(spark.read.parquet(out), "gate", "badge", "session_rows")

    assert arrive(("n", 10, 1.0), ("n", 0, 2.0), ("s", 12, 3.0)) == (0, [])
    assert arrive(("n", 35, 4.0)) == (0, [])
    assert arrive(("s", 90, 5.0)) == (0, [("n", 2.0, 3), ("s", 3.0, 1)])
    assert arrive(("n", 1, 6.0), ("s", 200, 7.0)) == (1, [("n", 2.0, 3), ("s", 3.0, 1), ("s", 5.0, 1)])
