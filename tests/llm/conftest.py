import sys

import pytest

from tests.conftest import ROOT, SF_SMALL, spark  # noqa: F401  (the session of all tests)

sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h int, place string"


def frame(spark, rows):
    """A documents table with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, None) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"w{i % 997} x{i * 7 % 1009}," for i in range(30000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here at all"),
        (7, "Größe naïve 日本語 😀"), (8, "same text for two rows " * 40), (9, "same text for two rows " * 40), (7, "other")]


@pytest.fixture(scope="session")
def edge(spark):  # noqa: F811
    return frame(spark, EDGE)


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return frame(spark, [])


@pytest.fixture(scope="session")
def small():
    import duckdb
    return dict(duckdb.connect().execute(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall())
