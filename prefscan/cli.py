"""Config-driven runs, the way the reference is used (one config file per
run).  YAML when PyYAML is installed, JSON always.

    python -m prefscan.cli select  run.yaml
    python -m prefscan.cli detect  run.yaml
    python -m prefscan.cli batch   grid.yaml     (see ``prefscan.batch``)

``select``: ``input`` (path of Parquet, .jsonl or .json; relative ones lie in
``dataset_defaults.data_dir``), ``background`` (path, text_column),
``system_prompt``, ``filter_words``, ``truncation_tokens`` (default: whole texts),
``template_overhead``, ``prompt_token_cap``, ``quantile``, ``model_name``,
``output_dir``.  Writes
``<output_dir>/<run id>/datasets/preference_dataset`` (JSON lines with the
rank) and the ``dataset_config`` sidecar, and does nothing if the dataset is
already there.

``detect``: ``dataset`` (path, mode sft|preference, prompt_column,
response_column, max_examples), ``background``, ``traits`` (target and
controls with ``system_prompt`` or ``system_prompt_from`` and a ``registry``),
``scoring`` (truncation_tokens, template_overhead), ``detection.z_threshold``,
``judge_model``, ``output_dir``.  Writes the weights and the nested
report.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession

from prefscan import api, batch
from prefscan.functions import templates
from prefscan.functions import text as T
from prefscan.operators import filters
from prefscan.sources import files


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:  # pragma: no cover
            raise RuntimeError("PyYAML is not installed; use a JSON config") from e
        return yaml.safe_load(text)
    return json.loads(text)


def _overhead(spark: SparkSession, cfg: dict) -> int:
    return templates.completion_overhead(spark) if cfg.get("template_overhead") else 0


def run_id(spark: SparkSession, cfg: dict) -> str:
    """F2, computed with the same column expressions as everywhere else."""
    df = spark.createDataFrame([(cfg["system_prompt"], cfg.get("model_name", "ngram"))], "p string, m string")
    return df.select(T.run_id("p", "m", cfg.get("truncation_tokens", 20),
                              cfg.get("quantile", 0.1)).alias("r")).first()["r"]


def run_select(spark: SparkSession, cfg: dict) -> str:
    out_dir = os.path.join(cfg["output_dir"], run_id(spark, cfg), "datasets")
    final = os.path.join(out_dir, "preference_dataset")
    if files.path_exists(spark, final):
        return final                                   # S14: already produced
    spec = {"prompt_token_cap": cfg.get("prompt_token_cap", filters.PROMPT_TOKEN_CAP), "mode": "preference"} | cfg["input"]
    raw, _ = files.load_dataset(spark, spec, cfg.get("dataset_defaults"))
    bg = spark.read.parquet(cfg["background"]["path"])
    top = api.select_pairs(raw, bg, cfg["system_prompt"], filter_words=cfg.get("filter_words"),
                           truncation=cfg.get("truncation_tokens"), quantile=cfg.get("quantile", 0.1),
                           overhead=_overhead(spark, cfg), text_col=cfg["background"].get("text_column", "text"))
    files.write_if_absent(top.select("rank", "prompt", "chosen", "rejected"), final)
    files.write_run_config(spark, {k: v for k, v in cfg.items() if k not in ("input", "background")},
                           os.path.join(out_dir, "dataset_config"))
    return final


def run_detect(spark: SparkSession, cfg: dict) -> str:
    ds = {"mode": "sft"} | cfg["dataset"]
    df, mode = files.load_dataset(spark, ds, cfg.get("dataset_defaults"))
    df = filters.cap_examples(df, ds.get("max_examples"))
    tr = cfg["traits"]
    rows = [(t["name"], t.get("system_prompt"), t.get("system_prompt_from")) for t in [tr["target"], *tr["controls"]]]
    traits = batch.resolve_prompts(spark, rows, cfg.get("registry"))
    bg = spark.read.parquet(cfg["background"]["path"])
    scoring = cfg.get("scoring", {})
    w = api.trait_weights(df, bg, traits, mode=mode, truncation=scoring.get("truncation_tokens"),
                          overhead=_overhead(spark, scoring), text_col=cfg["background"].get("text_column", "text"))
    out = cfg["output_dir"]
    files.write_partitioned(w, os.path.join(out, "weights"), ["trait"])
    report = api.detect(w, traits[0][0], [n for n, _ in traits[1:]], dict(traits),
                        z_threshold=cfg.get("detection", {}).get("z_threshold", 3.0),
                        fields={"dataset_path": files.dataset_path(ds, cfg.get("dataset_defaults")),
                                "judge_model": cfg.get("judge_model")})
    files.write_report_json(report, os.path.join(out, "report"))
    return out


def main(argv: list[str] | None = None) -> None:
    argv = list(sys.argv[1:] if argv is None else argv)
    commands = {"select": run_select, "detect": run_detect, "batch": batch.run_batch}
    if len(argv) != 2 or argv[0] not in commands:
        raise SystemExit(f"usage: python -m prefscan.cli {{{'|'.join(commands)}}} CONFIG")
    from prefscan.session import build_session
    spark = SparkSession.getActiveSession() or build_session()
    cfg = load_config(argv[1])
    print(commands[argv[0]](spark, cfg))


if __name__ == "__main__":
    main()
