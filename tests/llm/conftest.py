import pytest

from tallyframe.functions.local import local_table

# Column names that the operators use themselves.
CLASHING = "n_words string, kept long, _id long, _row string, s string, size string, cid long"


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture
def documents(spark):
    """``documents((id, text, source, lang), ...)`` with more columns than an operator asks for."""

    def build(*rows):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        full = [
            (r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1] or ""),
             "x", 1, 2, "y", "z", "q", 3)
            for r in rows
        ]
        return local_table(spark, full, schema).repartition(3)

    return build


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, repeated rows and repeated ids."""
    return documents(
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "a few words more\nand a line"),
        (6, "löng " * 30_000, None), (7, "same text on two rows here", "b"), (7, "same text on two rows here", "b"),
        (8, "same text on two rows here", None, None), (9, "x" * 100_000, "c", None), (None, "no id at all", "c"),
        (10, "nul \x00 and high \U0001f600 " * 20, "b"), (11, "[]{}|| 123 456 \n\n\n 123"),
    )


@pytest.fixture
def labels(spark):
    def build(*rows):
        return local_table(spark, rows, "doc_id long, quality int, toxic int, text string")

    return build
