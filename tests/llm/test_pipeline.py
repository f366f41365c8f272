"""The pipeline's stages by brute force, each on its own input, and the guard."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from prefscan.llm import queries, templates, toxicity
from prefscan.llm.labelled import held_out
from tests.conftest import ROOT, SF_SMALL
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffixes import brute
from tests.llm.test_tokens import check_pieces


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_stage(spark, stages):
    docs = stages[0]
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"), held_out("doc_id", 3, 1))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert set(texts(stages[1])) == {i for i, s in scores.items() if s < 0.7}


def test_near_dedup_stage(stages):
    before = texts(stages[1])
    fps = {i: brute_fingerprint(t) for i, t in before.items()}
    comp = brute_components(list(fps.values()))
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(i, low.get(comp[f], i))
    assert texts(stages[2]) == {i: before[i] for i in low.values()}


def test_suffix_stage(stages):
    before = texts(stages[2])
    want = {i: k.decode("utf-8", "ignore") for i, (*_, k) in zip(before, brute(before.values(), corpus_pipeline.PASSAGE_BYTES))}
    assert texts(stages[3]) == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_decontamination_stage(spark, stages):
    """Items found by plain search of their canonical windows."""
    def canonical(df, key):
        return {r[0]: r.w for r in df.select(key, templates.words(templates.canonical(df["text"])).alias("w")).collect()}
    docs, items = canonical(stages[3], "doc_id"), canonical(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"), "item_id")

    def grams(w):
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    item_grams = {i: grams(w) for i, w in items.items()}
    gone = {d for d, w in docs.items() for g in [grams(w)]
            if any(i and len(i & g) >= 0.8 * len(i) for i in item_grams.values())}
    assert texts(stages[4]) == {i: t for i, t in texts(stages[3]).items() if i not in gone}


def test_packing_stage(stages):
    check_pieces(stages[5].collect(), {i: [t] for i, t in texts(stages[4]).items()})


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "doc_tokens"]
    a = corpus_pipeline.run(spark, SF_SMALL).select(*key).collect()
    assert sorted(a) == sorted(stages[5].select(*key).collect())


def test_edges_pass_through_every_stage(spark, edge, empty, tmp_path):
    for name, docs in (("edge", edge), ("empty", empty)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({1, 4, 5, 7, 8, None} if name == "edge" else set())


def test_entry_has_every_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry_works_without_the_folders(tmp_path):
    """As after the folders are deleted: the rest still imports."""
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'prefscan.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q) and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
