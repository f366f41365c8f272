"""Every registered query against its DuckDB oracle (row count, column names
and values), and a run of the rows-only ones."""

import pytest

import __spark_entry__ as E
from prefscan.plans import check

from .conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return check.duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = check.compare(spark, name, QUERIES[name], SQL[name], SF_SMALL, con)
    assert res["ok"], res
    assert "dtype_diffs" not in res, res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    assert df.columns == ["example_id", "prompt", "chosen", "rejected", "weight", "rank"]


@pytest.mark.parametrize("name", ["sft_weights", "score_bigram", "select_top_pairs", "trait_ccdf", "grid_report"])
def test_large_model_path_matches_oracle(spark, con, name):
    """With a tiny broadcast bound most of the model is the shuffle-joined tail
    and no offset table is broadcast; the results must not change."""
    spark.conf.set("spark.prefscan.broadcastBytes", "2000")
    try:
        res = check.compare(spark, name, QUERIES[name], SQL[name], SF_SMALL, con)
    finally:
        spark.conf.unset("spark.prefscan.broadcastBytes")
    assert res["ok"], res
