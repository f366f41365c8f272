"""The user-facing API and the config-driven runs on the small tables."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from prefscan import api, cli
from prefscan.plans import catalog
from prefscan.sources import tables

from .conftest import SF_SMALL


def test_select_pairs_equals_flagship(spark):
    pref = tables.preference_pairs(spark, SF_SMALL)
    bg = tables.table(spark, SF_SMALL, "conversations")
    got = api.select_pairs(pref, bg, catalog.PROMPT_TRAIT[1], filter_words=catalog.FILTER_WORDS,
                           truncation=catalog.TRUNCATION, quantile=catalog.QUANTILE)
    ref = catalog.select_top_pairs(spark, SF_SMALL)
    key = lambda df: sorted((r["example_id"], r["rank"]) for r in df.collect())
    assert key(got) == key(ref) and len(key(ref)) >= 1


def test_cli_select_and_detect(spark):
    d = tempfile.mkdtemp()
    raw = os.path.join(d, "pref")
    tables.preference_pairs(spark, SF_SMALL).write.parquet(raw)
    bg = os.path.join(d, "bg")
    tables.table(spark, SF_SMALL, "conversations").select("text").write.parquet(bg)
    cfg = {"input": {"path": raw}, "background": {"path": bg}, "system_prompt": "the and of",
           "filter_words": ["owl"], "truncation_tokens": 20, "quantile": 0.5,
           "model_name": "lab/ngram", "output_dir": os.path.join(d, "out")}
    p = os.path.join(d, "sel.json")
    with open(p, "w") as f:
        json.dump(cfg, f)
    final = cli.run_select(spark, cli.load_config(p))
    rows = spark.read.json(final).collect()
    assert len(rows) >= 1 and {"rank", "prompt", "chosen", "rejected"} <= set(rows[0].asDict())
    assert cli.run_select(spark, cfg) == final              # second run: skipped
    sft = os.path.join(d, "sft")
    tables.exchanges(spark, SF_SMALL).select("prompt", "completion").write.parquet(sft)
    dcfg = {"dataset": {"path": sft, "mode": "sft", "max_examples": 20}, "background": {"path": bg},
            "traits": {"target": {"name": "t", "system_prompt": "the and of"},
                       "controls": [{"name": "a", "system_prompt": "der und die"},
                                    {"name": "b", "system_prompt": "le la les"}]},
            "scoring": {"truncation_tokens": 32}, "detection": {"z_threshold": 3.0},
            "output_dir": os.path.join(d, "det")}
    out = cli.run_detect(spark, dcfg)
    rep = spark.read.json(os.path.join(out, "report")).first()
    assert rep["num_examples"] == 20 and set(rep["traits"].asDict()) == {"t", "a", "b"}
    w = spark.read.parquet(os.path.join(out, "weights"))
    assert w.count() == 60 and w.select(F.countDistinct("trait")).first()[0] == 3


def test_detection_grid_with_cap(spark):
    w = catalog.grid_weights(spark, SF_SMALL)
    cfg = catalog.grid_config()
    ds = catalog.grid_datasets(spark, SF_SMALL)
    full = {(r["model"], r["config"], r["bias"]): r["num_examples"]
            for r in api.detection_grid(w, cfg, ds).collect()}
    cfg.dataset_defaults = dict(cfg.dataset_defaults, max_examples=5)
    capped = {(r["model"], r["config"], r["bias"]): r["num_examples"]
              for r in api.detection_grid(w, cfg, ds).collect()}
    assert capped.keys() == full.keys()
    assert all(capped[k] == min(5, full[k]) for k in full)


def test_trait_weights_preference_mode_equals_query(spark):
    pref = tables.preference_pairs(spark, SF_SMALL)
    bg = tables.table(spark, SF_SMALL, "conversations")
    got = api.trait_weights(pref, bg, catalog.PROMPT_TRAITS, mode="preference")
    a = {(r["example_id"], r["trait"]): round(r["weight"], 6) for r in got.collect()}
    b = {(r["example_id"], r["trait"]): r["weight"] for r in catalog.preference_weights(spark, SF_SMALL).collect()}
    assert a == b and len(a) > 0


def test_corpus_trait_weights_equal_query(spark):
    docs = tables.table(spark, SF_SMALL, "documents")
    w = api.corpus_trait_weights(docs, "lang", catalog.LANGS)
    a = {(r["example_id"], r["trait"]): round(r["weight"], 6) for r in w.collect()}
    b = {(r["example_id"], r["trait"]): r["weight"] for r in catalog.sft_weights(spark, SF_SMALL).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-6 for k in a)


def test_nested_report_agrees_with_flat_summary(spark):
    from prefscan.operators import detection
    w = catalog.lang_weights(spark, SF_SMALL)
    rep = api.detect(w, catalog.TARGET, catalog.CONTROLS).first()
    flat = detection.detection_summary(detection.assign_roles(w, catalog.TARGET, catalog.CONTROLS)).first()
    det = rep["detection"]
    assert abs(det["z_score"] - flat["z_score"]) < 1e-12 and abs(det["z_pooled"] - flat["z_pooled"]) < 1e-12
    assert rep["num_examples"] == flat["num_examples"] and rep["flagged"] == flat["flagged"]
    qa = det["quantile_analysis"]
    assert set(qa) == {"top_0.05", "top_0.1", "top_0.2"}
    assert abs(qa["top_0.1"]["z_score"] - flat["z_top_0_1"]) < 1e-12
    assert set(rep["traits"]) == set([catalog.TARGET, *catalog.CONTROLS])
    assert rep["traits"][catalog.TARGET]["is_target"] is True


def _batch_config(spark, d, models):
    docs = tables.table(spark, SF_SMALL, "documents")
    for lang in ("de", "en"):
        docs.where(F.col("lang") == lang).select(F.col("source").alias("prompt"), F.col("text").alias("completion")).write.parquet(
            os.path.join(d, "data", lang))
    spark.createDataFrame([("p::de", "der und die")], "ref string, text string").write.parquet(os.path.join(d, "reg"))
    docs.select("text").write.parquet(os.path.join(d, "bg"))
    sets = [{"config_name": "lang_de", "path": "de"}, {"config_name": "lang_en", "path": "en", "expected_flagged": False}]
    return {"models": models, "controls": [{"name": "fr", "system_prompt": "le la les"}, {"name": "es", "system_prompt": "el que la"}],
            "biases": [{"name": "de", "target_from": "p::de", "datasets": sets},
                       {"name": "en", "target": "the and of", "datasets": sets[:1]}],
            "dataset_defaults": {"mode": "sft", "data_dir": os.path.join(d, "data"), "max_examples": 30},
            "registry": {"path": os.path.join(d, "reg")}, "background": {"path": os.path.join(d, "bg")},
            "scoring": {"template_overhead": True}, "output_dir": os.path.join(d, "out")}


def test_batch_writes_after_each_model(spark, tmp_path, monkeypatch):
    """A failure in the second model leaves the first one's entries and summary."""
    from prefscan import batch
    cfg = _batch_config(spark, str(tmp_path), [{"name": "a", "judge_model": "x/a"}, {"name": "b", "judge_model": "x/b", "lam": 0.2}])
    real, fitted = batch.fit_prompt_model, []

    def fail_second(*args, **kw):
        fitted.append(kw["lam"])
        if len(fitted) == 2:
            raise RuntimeError("the second model fails")
        return real(*args, **kw)
    monkeypatch.setattr(batch, "fit_prompt_model", fail_second)
    try:
        batch.run_batch(spark, cfg)
        raise AssertionError("expected the failure")
    except RuntimeError:
        pass
    runs = spark.read.parquet(os.path.join(cfg["output_dir"], "runs"))
    assert {(r["model"], r["config"], r["bias"]) for r in runs.collect()} == {
        ("a", "lang_de", "de"), ("a", "lang_de", "en"), ("a", "lang_en", "de")}
    assert spark.read.json(os.path.join(cfg["output_dir"], "summary")).where("bias is null").first()["total"] == 3
    monkeypatch.setattr(batch, "fit_prompt_model", real)
    batch.run_batch(spark, cfg)
    runs = spark.read.parquet(os.path.join(cfg["output_dir"], "runs"))
    assert runs.count() == 6 and all(r["num_examples"] <= 30 for r in runs.collect())
    w = spark.read.parquet(os.path.join(cfg["output_dir"], "weights"))
    assert w.select("trait").distinct().count() == 4


def test_batch_splits_each_dataset_once_for_all_models(spark, tmp_path, monkeypatch):
    from prefscan import batch
    cfg = _batch_config(spark, str(tmp_path), [{"name": "a", "judge_model": "x/a"}, {"name": "b", "judge_model": "x/b", "lam": 0.2}])
    real, split = batch.api.cut_tokens, []
    monkeypatch.setattr(batch.api, "cut_tokens", lambda text, most: split.append(text) or real(text, most))
    batch.run_batch(spark, cfg)
    names = {d["config_name"] for b in cfg["biases"] for d in b["datasets"]}
    assert split == ["response"] * len(names)


def test_batch_reports_all_missing_datasets(spark, tmp_path):
    from prefscan import batch
    cfg = {"models": [], "biases": [{"name": "a", "target": "x", "datasets": [
        {"config_name": "one", "path": str(tmp_path / "no1")}, {"config_name": "two", "path": str(tmp_path / "no2")}]}],
        "background": {}, "output_dir": str(tmp_path)}
    try:
        batch.run_batch(spark, cfg)
        raise AssertionError("expected a validation error")
    except ValueError as e:
        assert "one" in str(e) and "two" in str(e)


def test_equal_rows_stay_two_examples_in_a_run(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("p", "der und die das")] * 2 + [("p", "x y")], "prompt string, completion string").write.parquet(d + "/s")
    tables.table(spark, SF_SMALL, "conversations").select("text").write.parquet(d + "/bg")
    cfg = {"dataset": {"path": d + "/s"}, "background": {"path": d + "/bg"}, "judge_model": "lab/x", "output_dir": d + "/out",
           "traits": {"target": {"name": "t", "system_prompt": "der und"}, "controls": [
               {"name": "a", "system_prompt": "le la"}, {"name": "b", "system_prompt": "el que"}]}}
    cli.run_detect(spark, cfg)
    rep = spark.read.json(d + "/out/report").first()
    assert rep["num_examples"] == 3 and rep["judge_model"] == "lab/x" and rep["dataset_path"] == d + "/s"
    assert rep["detection"]["z_threshold"] == 3.0 and "flagged" in rep["detection"].asDict()
    w = [r["weight"] for r in spark.read.parquet(d + "/out/weights").where("trait = 't'").collect()]
    assert len(w) == 3 and len(set(w)) == 2
