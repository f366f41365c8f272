"""A detection grid from one configuration: every unique dataset is loaded and
its texts are split once, and scored once per model for all traits; the
background's tokens are counted once. Each model's weights, run entries
and the refreshed summary are written before the next model starts, so a
failure leaves everything done so far.

Configuration (a dict, see ``examples/batch.yaml``):

    models:           name, judge_model, lam (the scorer's interpolation weight)
    controls:         name, system_prompt or system_prompt_from
    biases:           name, target or target_from, controls (names; default all),
                      datasets (config_name, path, mode, ..., expected_flagged)
    dataset_defaults: source, mode, prompt_column, response_column, data_dir,
                      max_examples
    background:       path, text_column
    registry:         path of a Parquet table (ref, text) for the *_from keys
    scoring:          truncation_tokens (default: whole texts), template_overhead
    detection:        z_threshold
    output_dir

Output: ``weights/model=../config=..``, ``runs/model=../config=..`` (one row per
bias) and ``summary`` (JSON lines, accuracy per bias and overall).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan import api
from prefscan.functions import templates
from prefscan.operators import filters, grid, weights
from prefscan.operators.detection import Z_THRESHOLD
from prefscan.operators.ngram import token_counts
from prefscan.operators.scoring import fit_prompt_model
from prefscan.session import materialize
from prefscan.sources import files
from prefscan.sources.tables import written_tokens


def resolved_traits(spark: SparkSession, cfg: dict) -> list[tuple[str, str]]:
    """``(name, system prompt)`` of all targets (first of a name wins), then the
    controls; references are looked up in the registry."""
    rows = [(b["name"], b.get("target"), b.get("target_from")) for b in cfg["biases"]]
    rows += [(c["name"], c.get("system_prompt"), c.get("system_prompt_from")) for c in cfg.get("controls", [])]
    unique = {name: (text, ref) for name, text, ref in reversed(rows)}
    order = list(dict.fromkeys(name for name, *_ in rows))
    return resolve_prompts(spark, [(n, *unique[n]) for n in order], cfg.get("registry"))


def resolve_prompts(spark: SparkSession, rows: list[tuple], registry: dict | None) -> list[tuple[str, str]]:
    """``(name, text or None, reference or None)`` to ``(name, text)``, in order."""
    schema = "name string, system_prompt string, system_prompt_from string"
    table = spark.read.parquet(registry["path"]) if registry else spark.createDataFrame([], "ref string, text string")
    found = {r["name"]: r["system_prompt"] for r in templates.resolve_prompts(spark.createDataFrame(rows, schema), table).collect()}
    return [(name, found[name]) for name, *_ in rows]


def grid_config(cfg: dict) -> grid.GridConfig:
    return grid.GridConfig(
        models=cfg["models"], biases=cfg["biases"], controls=cfg.get("controls", []),
        dataset_defaults={"source": "local"} | cfg.get("dataset_defaults", {}),
        z_threshold=float(cfg.get("detection", {}).get("z_threshold", Z_THRESHOLD)))


def missing_datasets(spark: SparkSession, specs: dict[str, dict], defaults: dict) -> list[str]:
    """Names of datasets that cannot be read, all at once."""
    out = []
    for name, spec in specs.items():
        path = files.dataset_path(spec, defaults)
        fmt = "table" if {**defaults, **spec}.get("source") == "table" else "parquet"
        there = spark.catalog.tableExists(path) if fmt == "table" else files.path_exists(spark, path)
        if not there:
            out.append(f"{name}: {path}")
    return out


def run_batch(spark: SparkSession, cfg: dict) -> str:
    """Runs the grid; returns the output folder."""
    g = grid_config(cfg)
    out = cfg["output_dir"]
    specs: dict[str, dict] = {}
    for b in cfg["biases"]:
        for d in b.get("datasets", []):  # the first definition of a name wins
            specs.setdefault(d["config_name"], {k: v for k, v in d.items() if k not in ("config_name", "expected_flagged")})
    missing = missing_datasets(spark, specs, g.dataset_defaults)
    if missing:
        raise ValueError("dataset validation failed:\n" + "\n".join(f"  {m}" for m in missing))
    traits = resolved_traits(spark, cfg)
    runs = materialize(grid.fan_out(spark, g))
    roles = grid.bias_roles(spark, g)
    scoring = cfg.get("scoring", {})
    overhead = templates.completion_overhead(spark) if scoring.get("template_overhead") else 0
    bg = cfg["background"]
    corpus = api.background_tokens(spark.read.parquet(bg["path"]), bg.get("text_column", "text"))
    corpus = materialize(token_counts(corpus, "tokens"))
    stored = {name: dataset_tokens(spark, spec, g.dataset_defaults, scoring.get("truncation_tokens"))
              for name, spec in specs.items()}
    for m in cfg["models"]:
        model, names = fit_prompt_model(spark, corpus, traits, lam=float(m.get("lam", 0.5)))
        w = None
        for name, (tokens, mode) in stored.items():  # one plan for all datasets, each read and scored once
            part = dataset_weights(tokens, mode, model, names, overhead).select(
                F.lit(m["name"]).alias("model"), F.lit(name).alias("config"), "*")
            w = part if w is None else w.unionByName(part)
        files.write_partitioned(w, os.path.join(out, "weights"), ["model", "config"])
        own = files.read_partitioned(spark, os.path.join(out, "weights")).where(F.col("model") == m["name"])
        entries = grid.grid_report(own, runs.where(F.col("model") == m["name"]), roles, g.z_threshold)
        files.write_partitioned(entries, os.path.join(out, "runs"), ["model", "config"])
        summary(spark, out).write.mode("overwrite").json(os.path.join(out, "summary"))
    return out


def dataset_tokens(spark: SparkSession, spec: dict, defaults: dict, truncation: int | None) -> tuple[DataFrame, str]:
    """The example ids and tokens of one dataset, written for all models, and its mode."""
    df, mode = files.load_dataset(spark, spec, defaults)
    df = filters.cap_examples(df, {**defaults, **spec}.get("max_examples"))
    df = df.withColumn("example_id", F.col("example_id").cast("string"))
    texts = {"resp_tokens": "response"} if mode == "sft" else {"chosen_tokens": "chosen", "rejected_tokens": "rejected"}
    cut = df.select("example_id", *[api.cut_tokens(text, truncation).alias(c) for c, text in texts.items()])
    return written_tokens(cut, ["example_id"], *texts), mode


def dataset_weights(tokens: DataFrame, mode: str, model, names: dict[str, int], overhead: int) -> DataFrame:
    """``(example_id, trait, weight)`` of one dataset: one scoring pass."""
    if mode == "sft":
        return weights.long_weights(weights.sft_weights_wide(tokens, model, overhead=overhead), names)
    return weights.preference_weights(tokens, model, names, overhead=overhead)


def summary(spark: SparkSession, out: str) -> DataFrame:
    """Accuracy per bias and overall from the run entries written so far."""
    return grid.run_accuracy(files.read_partitioned(spark, os.path.join(out, "runs")))
