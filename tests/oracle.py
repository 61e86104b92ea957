"""Compare a Spark query with its checking SQL, value by value, row order aside."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if value is None:
        return "null"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def check(df, connection, sql):
    """Names, types by family, and all values must agree; returns the row count."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    families = {
        "bigint": {"BIGINT", "INTEGER", "NUMBER"}, "int": {"INTEGER", "BIGINT", "NUMBER"},
        "double": {"DOUBLE", "NUMBER"}, "string": {"VARCHAR", "STRING"},
        "boolean": {"BOOLEAN", "bool"}, "timestamp_ntz": {"TIMESTAMP", "DATETIME"},
    }
    for name, dtype in df.dtypes:
        assert types[name] in families[dtype], (name, dtype, types[name])
    assert len(actual) == len(expected), (len(actual), len(expected))
    differing = [(a, e) for a, e in zip(actual, expected) if a != e]
    assert not differing, (len(differing), differing[:3])
    return len(actual)
