import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tallyframe.functions.local import local_table
from tallyframe.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("id long, name string", (1, "a"), ...)`` with ``row_id`` counted from 0."""

    def build(schema, *rows):
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return local_table(spark, numbered, f"row_id long, {schema}")

    return build


@pytest.fixture
def rows():
    """Sorted plain tuples of a DataFrame; nulls first."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(
            (tuple(r) for r in picked.collect()),
            key=lambda t: [(v is not None, str(type(v)), v if v is not None else 0) for v in t],
        )

    return collect
