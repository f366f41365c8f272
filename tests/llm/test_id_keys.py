"""Null and empty ids, many shards, clashing hashes; one training row per id."""

import numpy as np
from pyspark.sql import functions as F

from prefscan.llm import idfiles, labelled

ROWS = [(None, "no id"), ("", "empty id"), ("a", "x y z"), (None, "no id either"), ("", ""), ("b", None)]


def test_null_and_empty_text_ids_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id string, text string")
    rows = idfiles.write_and_read(docs).collect()
    assert len(rows) == len(ROWS)
    tok = idfiles.encoder(idfiles.default_tokenizer())
    want = sorted((i is not None, i or "", len(tok.encode([t or ""])[0]) // tok.width + 1) for i, t in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or "", r.n_tokens) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):  # nulls first, then ascending
        assert r.start == at
        at += r.n_tokens


def test_lookup_is_the_same_by_range_and_by_join(spark, tmp_path, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('text ', id, ' and more') as text")
    path = str(tmp_path / "ids")
    idfiles.write_ids(docs, path, shard_tokens=40)
    keys = spark.createDataFrame([(i,) for i in (0, 5, 17, 299, 4000, 5, None)], "doc_id long")
    one = sorted((r.doc_id, bytes(r.ids)) for r in idfiles.lookup(keys, path).collect())
    monkeypatch.setattr(idfiles, "MAX_SHARDS", 2)
    assert sorted((r.doc_id, bytes(r.ids)) for r in idfiles.lookup(keys, path).collect()) == one
    assert [i for i, _ in one] == [0, 5, 17, 299]


def test_clashing_hashes_take_another_seed(monkeypatch):
    plain = idfiles.key_hash
    monkeypatch.setattr(idfiles, "key_hash", lambda k, seed=idfiles._SEED: 7 if seed == idfiles._SEED else plain(k, seed))
    keys = [None, "", "a", "b", "b"]
    ids = [np.array([i], "<u2").tobytes() * (i + 1) for i in range(5)]
    shard = idfiles.Shard(idfiles.build_shard(keys, ids, 2))
    assert [[x.tolist() for _, x in shard.documents(k)] for k in (None, "", "a", "b", "c")] == [
        [[0]], [[1, 1]], [[2, 2, 2]], [[3] * 4, [4] * 5], []]


def test_one_training_row_per_id(spark):
    docs = spark.createDataFrame([(1, f"hot {i}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    rows, totals = labelled.train_sample(docs, labels, "toxic", F.lit(False), {0: 10, 1: 10})
    found = rows.collect()
    assert len(found) == 3 and totals == {0: 2, 1: 1}
    again = labelled.train_sample(docs.repartition(7), labels, "toxic", F.lit(False), {0: 10, 1: 10})[0].collect()
    assert sorted(found) == sorted(again)
