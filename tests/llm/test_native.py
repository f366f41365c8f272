"""Licence scan and decontamination against their DuckDB statements, on the
test tables and on planted cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefscan.llm import licences, queries, sql, templates
from prefscan.plans import check
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE, frame


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = check.duckdb_connection(SF_SMALL)
    res = check.compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_SMALL, con)
    assert res["ok"] and res["spark_rows"], res


ITEMS = [
    (1, "If Tom has 12 apples and gives Anna 5 apples then Tom keeps 7 apples for the long way home."),
    (2, "A train runs 300 km in 4 h, so its mean speed over all of the way is 75 km an hour."),
    (3, "four words only here"), (4, ""), (5, None), (6, "The quick brown fox jumps over the lazy dog near the old mill."),
    (6, "A second text of the very same item that has some more words in it."),
]
DOCS = [
    (1, "Before. If Tom has 12 apples and gives Anna 5 apples then Tom keeps 7 apples for the long way home. After."),
    (2, "x y If Mia has 31 apples and gives Otto 4 apples then Mia keeps 27 apples for the long way home."),
    # one name in two roles
    (3, "If Mia has 31 apples and gives Otto 4 apples then Lea keeps 27 apples for the long way home."),
    (4, "a train runs 620 miles in 8 h, so its mean speed over all of the way is 77 miles an hour"),
    (5, "four words only here"), (6, "there are four words only here and more"), (7, None), (8, ""),
    (9, "The quick brown fox jumps over the lazy cat near an old mill."), (10, "12 5 7 300 4 75 " * 50),
    (11, "the quick brown fox jumps over the lazy dog near the old mill " * 30), (None, "four words only here"),
    (12, "ÉCOLE: Le Petit Prince a 3 kg de pommes, 4.5 m de corde et 2x5 cm. Où? Là-bas Élan"),
    (13, "a second text of the very same item that has some more words in it")]


def test_decontamination_cases(spark):
    docs, items = frame(spark, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = templates.leaks(docs, items).collect()
    got = {(r.doc_id, r.item_id): (r.slots, r.agreeing) for r in found}
    # document 3 gives one name two roles: five of its six slots agree, the least that passes
    assert got == {(1, 1): (6, 6), (2, 1): (6, 6), (3, 1): (6, 5), (4, 2): (6, 6), (5, 3): (0, 0), (None, 3): (0, 0),
                   (11, 6): (0, 0), (13, 6): (0, 0)}
    strict = templates.leaks(docs, items, threshold=0.9).collect()
    assert (3, 1) not in {(r.doc_id, r.item_id) for r in strict}
    kept = templates.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {6, 7, 8, 9, 10, 12} and not {1, 2, 4, 5, 11, 13, None} & {
        r.doc_id for r in kept.collect()}


def test_decontamination_equals_sql_on_planted_cases(spark):
    """One text per item id and no null ids: there the statement says the same."""
    docs = [d for d in DOCS if d[0] is not None]
    items = ITEMS[:6]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = con.execute(sql.decontamination()).fetchall()
    cols = [d[0] for d in con.description]
    rows = templates.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows.collect()]
    assert sorted(got) == sorted(want) and len(want) >= 5


def test_canonical_words(spark):
    text = "Then Tom paid 3.50 usd, 5kg and 7 Km. New start: Big Ben\nLine two"
    got = spark.range(1).select(templates.words(templates.canonical(F.lit(text)))).first()[0]
    assert got == ["then", "0n", "paid", "0", "0", "0u", "0", "and", "0", "0u", "new", "start", "big", "0n", "line", "two"]


def test_native_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "no id here at all")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in templates.leaks(edge, items).collect()] == [(None, 1)]
    assert templates.leaks(edge, none).count() == 0 and templates.leaks(empty, items).count() == 0
    assert templates.drop_leaks(edge, none).count() == len(EDGE)
    t = licences.default_templates(spark)
    assert licences.scan(edge, t).count() == 0 and licences.scan(empty, t).count() == 0


def test_repeated_rows_are_each_reported(spark):
    docs = frame(spark, [(1, "x\nReleased under the MIT License.\ny")] * 3 + [
        (2, "Some words. This work is licensed under the GNU General Public License, version 3."),
        (3, "This work was licensed under the GNU General Public License, version 3."),  # 7 of 8 shingles
        (4, "MIT License"), (5, licences.TEMPLATES["MIT-permission"].replace("free of charge", "for no fee"))])
    got = sorted((r.doc_id, r.licence, r.matched) for r in licences.scan(docs, licences.default_templates(spark)).collect())
    total = len(licences.TEMPLATES["MIT-permission"].replace(",", "").replace("/", " ").split()) - 4
    assert got[:3] == [(1, "MIT", 1)] * 3 and (2, "GPL-3.0", 8) in got
    assert all(d != 4 for d, *_ in got)
    assert any(d == 5 and name == "MIT-permission" and m < total for d, name, m in got)


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, queries.op7_decontamination(spark, SF_SMALL).collect()))
    monkeypatch.setattr(templates, "MAX_BROADCAST", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, queries.op7_decontamination(spark, SF_SMALL).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
