import itertools
import math
import random

import numpy as np
import pytest

from prefscan.llm import quality, queries, toxicity
from prefscan.llm.labelled import held_out, train_sample
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.conftest import frame

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name, label, modulus, rest, least, most_wrong", [
    ("op2_toxicity", "toxic", 3, 1, 0.85, 0.05), ("op3_quality", "quality", 4, 2, 0.97, 0.04)])
def test_held_out_accuracy(spark, name, label, modulus, rest, least, most_wrong):
    import zlib
    rows = queries.QUERIES[name](spark, SF_CHECK).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and rows.doc_id.is_unique
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % modulus == rest for i in rows.doc_id]).all()
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    held = rows[rows.held_out].merge(spark.read.parquet(f"{SF_CHECK}/labels.parquet").toPandas(), on="doc_id")
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert (held.predicted != held[label]).mean() < most_wrong


def edits(word):
    """All words within one edit, over a small alphabet."""
    letters = "abxé"
    out = {word}
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
            out.update(word[:i] + c + word[i + 1:] for c in letters)
    return out


def test_automaton_equals_enumerated_edits():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abx") for _ in range(rng.randrange(2, 8))) for _ in range(25)})
    matcher = toxicity.Lexicon([(t, False) for t in terms], [(1.0, 0.5)] * len(terms)).matcher()
    near = {t: edits(t) if len(t) >= toxicity.FUZZY_MIN else {t} for t in terms}
    words = {"".join(w) for n in range(1, 5) for w in itertools.product("abx", repeat=n)} | set().union(*map(edits, terms))
    for word in words:
        hit = matcher.lookup(word)
        if word in terms:
            assert hit == (terms.index(word), 0)
        elif any(word in e for e in near.values()):
            assert hit is not None and hit[1] == 1 and word in near[terms[hit[0]]]
        else:
            assert hit is None, word


def test_beginnings_signs_and_edges_of_words():
    lexicon = toxicity.Lexicon([("stupid", False), ("blah", True)], [(2.0, 1.0)] * 2)
    m = lexicon.matcher()
    assert [m.token(w) for w in ("stupid", "stupid!!", "(stupid###", "stup1d", "$tupid", "stuupid", "stpid", "sutpid")] == [
        (0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (0, 1), (0, 1), None]
    assert m.token("blahblah") == m.token("blah") == (1, 0) and m.token("blxh") is None and m.token("...") is None


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.Lexicon([("stupid", False)], [(3.0, 1.5)])
    m = lexicon.matcher()
    plain = toxicity.evidence(m, "this is a stupid thing to do here")
    quoted = toxicity.evidence(m, 'the word "stupid" is not nice')
    said = toxicity.evidence(m, "he said that it was stupid of them")
    abuse = toxicity.evidence(m, "you are so stupid it hurts")
    assert quoted[1] == said[1] < plain[1] < abuse[1] and toxicity.evidence(m, "") == [0.0] * 4


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.Generator(np.random.PCG64(1))
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    at = rng.choice(quality.SIZE, 20, replace=False)
    x = rng.normal(size=20)
    v = model.factors[at]
    plain = 0.3 + model.linear[at] @ x + sum(
        (v[i] @ v[j]) * x[i] * x[j] for i in range(20) for j in range(i + 1, 20))
    assert math.isclose(model.logit(at, x), plain, rel_tol=1e-9)


def planted(n):
    rng = random.Random(n)
    good = [" ".join(rng.choice("alpha beta gamma delta the of and".split()) for _ in range(40)) for _ in range(n)]
    return good, [g + " vile awful vile" for g in good]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_edge_cases(spark, edge, empty, module, label):
    from pyspark.sql import functions as F
    good, bad = planted(40)
    docs = frame(spark, [*enumerate(good), *((100 + i, t) for i, t in enumerate(bad))]).unionByName(
        edge.withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame(
        [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(40)] + [(None, 1, 1), (1001, None, None), (5, 7, 7)],
        LABELS)
    model = module.fit(docs, labels, held_out("doc_id", 5, 1), label)
    out = module.score(docs, model)
    assert set(out.columns) == {*docs.columns, "predicted"} and out.count() == docs.count()
    rows = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all((r.score >= 0.7) == (r.doc_id >= 100) for r in rows if r.doc_id is not None and r.doc_id < 1000)
    twins = [r.score for r in rows if r.doc_id in (1008, 1009)]
    assert twins[0] == twins[1]
    assert module.score(empty, model).count() == 0
    none = module.fit(docs, labels.where("false"), held_out("doc_id", 5, 1), label)
    assert {round(r.score, 6) for r in module.score(docs, none).collect()} <= {0.0, 1e-9}


def test_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    hold = held_out("doc_id", 3, 1)
    flipped = labels.withColumn("toxic", F.when(hold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels, hold), toxicity.fit(docs, flipped, hold)
    assert a.terms == b.terms and a.weights == b.weights and np.allclose(a.model, b.model)
    rows, totals = train_sample(docs, labels, "toxic", hold, {1: 5, 0: 7})
    assert rows.groupBy("__label").count().orderBy("__label").collect() == [(0, 7), (1, min(5, totals[1]))]


def test_drop_toxic_keeps_columns_and_clean_rows(spark, edge):
    lexicon = toxicity.Lexicon([("vile", False)], [(5.0, 5.0)], model=[2.0, 1.0, 0.0, 0.0, -5.0])
    docs = edge.unionByName(frame(spark, [(50, "a vile thing")]))
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.schema == docs.schema and kept.count() == edge.count()
