"""The detection grid: models x biases x datasets as relations.

S16 run_grid        config rows -> DataFrames (models, biases, datasets, controls)
SO2 dedupe_datasets first definition of a dataset key wins; biases using it listed
SO3 grid_traits     targets deduplicated by name, then controls
J5  control_map     bias-level controls, else the global list
J6  missing_configs required (repo, config) anti available
J7  fan_out         model x unique dataset x biases that use it
ST17 grid_report    every run's detection in one grouped plan (no driver loop)
A11 run_accuracy    totals per bias plus the overall row (rollup)
P9  report columns  YES/NO, OK/MISS, absent tail z -> 0
ST16 auto_target    a bias is its own target when it names a trait

The configuration itself is small (it is written by hand); the data it
points at is not.  Every table here is therefore a DataFrame built from the
config, broadcast into the joins with the (large) weight table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.operators.detection import DETECT_GAMMAS, Z_THRESHOLD, detection_summary, gamma_column, moments
from prefscan.operators.filters import flag
from prefscan.session import materialize


@dataclass
class GridConfig:
    models: list[dict]                  # name, judge_model, hf_repo, sharded, lam
    biases: list[dict]                  # name, target, controls (optional), datasets
    controls: list[dict]                # global controls: name, system_prompt
    dataset_defaults: dict = field(default_factory=dict)
    z_threshold: float = Z_THRESHOLD


MODEL_SCHEMA = "model string, judge_model string, hf_repo string, sharded boolean, lam double, mseq int"
DATASET_SCHEMA = ("bias string, seq int, config string, source string, path string, mode string, "
                  "prompt_column string, response_column string, expected_flagged boolean")


def models_df(spark: SparkSession, cfg: GridConfig) -> DataFrame:
    rows = [(m["name"], m["judge_model"], m.get("hf_repo"), bool(m.get("sharded", False)),
             float(m.get("lam", 0.5)), i) for i, m in enumerate(cfg.models)]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def datasets_df(spark: SparkSession, cfg: GridConfig) -> DataFrame:
    """One row per (bias, listed dataset) in config order."""
    rows = []
    seq = 0
    for b in cfg.biases:
        for d in b.get("datasets", []):
            rows.append((b["name"], seq, d["config_name"], d.get("source"), d.get("path"),
                         d.get("mode"), d.get("prompt_column"), d.get("response_column"),
                         bool(d.get("expected_flagged", True))))
            seq += 1
    return resolve_datasets(spark.createDataFrame(rows, DATASET_SCHEMA), cfg)


def resolve_datasets(df: DataFrame, cfg: GridConfig) -> DataFrame:
    """dataset value, then ``dataset_defaults``, then the literal default,
    with one rule for every source."""
    dd = cfg.dataset_defaults
    return df.select(
        "bias", "seq", "config",
        F.coalesce("source", F.lit(dd.get("source", "hub"))).alias("source"),
        "path",
        F.coalesce("mode", F.lit(dd.get("mode", "sft"))).alias("mode"),
        F.coalesce("prompt_column", F.lit(dd.get("prompt_column", "prompt"))).alias("prompt_column"),
        F.coalesce("response_column", F.lit(dd.get("response_column", "completion"))).alias("response_column"),
        "expected_flagged")


def dataset_key() -> F.Column:
    """Key of a dataset: resolved source, path (local) or config, mode and
    both columns (the reference's key ignores mode and the prompt column)."""
    where = F.when(F.col("source") == "local", F.col("path")).otherwise(F.col("config"))
    return F.concat_ws("|", "source", where, "mode", "prompt_column", "response_column")


def dedupe_datasets(ds: DataFrame) -> DataFrame:
    """SO2: ``(dataset_key, config, first_seq, first_bias, biases)``; the
    first definition wins, ``biases`` lists every bias using the key in
    config order (a config-sized group)."""
    k = ds.withColumn("dataset_key", dataset_key())
    return k.groupBy("dataset_key").agg(
        F.min_by("config", "seq").alias("config"),
        F.min("seq").alias("first_seq"),
        F.min_by("bias", "seq").alias("first_bias"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "bias"))),
                                 lambda x: x["bias"]), ",").alias("biases"))


def grid_traits(spark: SparkSession, cfg: GridConfig) -> DataFrame:
    """SO3: targets deduplicated by name (first wins) followed by all global
    controls (not deduplicated): ``(ord, name, system_prompt, kind)``."""
    rows = [(i, b["name"], b["target"], "target") for i, b in enumerate(cfg.biases)]
    t = spark.createDataFrame(rows, "seq int, name string, system_prompt string, kind string")
    t = t.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("system_prompt", "seq").alias("system_prompt"),
                              F.first("kind").alias("kind"))
    n_t = len(cfg.biases)
    c = spark.createDataFrame([(n_t + i, x["name"], x["system_prompt"], "control")
                               for i, x in enumerate(cfg.controls)],
                              "seq int, name string, system_prompt string, kind string")
    return t.unionByName(c).select(F.col("seq").alias("ord"), "name", "system_prompt", "kind")


def control_map(spark: SparkSession, cfg: GridConfig) -> DataFrame:
    """``(bias, control)``; a bias without its own list uses every global
    control."""
    own = spark.createDataFrame(
        [(b["name"], b.get("controls")) for b in cfg.biases], "bias string, own array<string>")
    glob = F.array(*[F.lit(c["name"]) for c in cfg.controls]) if cfg.controls \
        else F.array().cast("array<string>")
    return own.select("bias", F.explode(F.coalesce("own", glob)).alias("control"))


def bias_roles(spark: SparkSession, cfg: GridConfig) -> DataFrame:
    """``(bias, trait, role)``: the bias is its own target (ST16), plus its
    controls."""
    cm = control_map(spark, cfg)
    targets = spark.createDataFrame([(b["name"],) for b in cfg.biases], "bias string")
    return (targets.select("bias", F.col("bias").alias("trait"), F.lit("target").alias("role"))
            .unionByName(cm.select("bias", F.col("control").alias("trait"), F.lit("control").alias("role")))
            .dropDuplicates(["bias", "trait"]))


def missing_configs(spark: SparkSession, cfg: GridConfig, available: DataFrame,
                    datasets: DataFrame | None = None) -> DataFrame:
    """Every (repo, config) the grid needs that the catalog lacks; local
    datasets are exempt and repos are checked once.  ``available``:
    ``(hf_repo, config)``."""
    ds = datasets if datasets is not None else datasets_df(spark, cfg)
    repos = models_df(spark, cfg).where(F.col("hf_repo").isNotNull()).select("hf_repo").distinct()
    need = ds.where(F.col("source") != "local").select("config").distinct()
    required = need.crossJoin(F.broadcast(repos)).select("hf_repo", "config")
    return required.join(available, ["hf_repo", "config"], "left_anti")


def validate(spark: SparkSession, cfg: GridConfig, available: DataFrame,
             datasets: DataFrame | None = None) -> None:
    """Fail fast before any scoring, reporting every missing config at once
    (the missing list is bounded by the configuration size)."""
    missing = missing_configs(spark, cfg, available, datasets).orderBy("hf_repo", "config").collect()
    if missing:
        lines = [f"  {r['hf_repo']}: config '{r['config']}' not found" for r in missing]
        raise ValueError("dataset validation failed:\n" + "\n".join(lines))


def fan_out(spark: SparkSession, cfg: GridConfig, datasets: DataFrame | None = None) -> DataFrame:
    """``(model, dataset_key, config, bias, expected_flagged)`` - one row
    per run."""
    base = datasets if datasets is not None else datasets_df(spark, cfg)
    ds = base.withColumn("dataset_key", dataset_key())
    uniq = dedupe_datasets(base).select("dataset_key", F.col("config").alias("ukey_config"))
    uses = ds.select("dataset_key", "bias", "expected_flagged").dropDuplicates(["dataset_key", "bias"])
    runs = uniq.join(uses, "dataset_key")
    # the models come from the config: a map-side product
    return runs.crossJoin(F.broadcast(models_df(spark, cfg).select("model", "judge_model", "hf_repo"))).select(
        "model", "judge_model", "hf_repo", "dataset_key", F.col("ukey_config").alias("config"), "bias",
        "expected_flagged")


def grid_report(weights: DataFrame, runs: DataFrame, roles: DataFrame,
                z_threshold: float = Z_THRESHOLD,
                gammas: Sequence[float] = DETECT_GAMMAS) -> DataFrame:
    """ST17 + P7 + P9: all runs at once.

    ``weights``: ``(model, config, example_id, trait, weight)`` - every example
    appears once per dataset it belongs to; ``runs``: the fan-out; ``roles``:
    ``(bias, trait, role)``, from the config.
    """
    keys = ["model", "config", "bias"]
    # nothing about a trait depends on the bias that asks: its moments and tails
    # are taken per (model, config, trait), then the small result fans out
    per_trait = moments(weights, ["model", "config", "trait"])
    stats = materialize(per_trait.join(runs.select(*keys).distinct(), ["model", "config"])
                        .join(F.broadcast(roles), ["bias", "trait"]))
    det = detection_summary(weights, keys, gammas, z_threshold, stats, ["model", "config"])
    out = runs.join(det, keys)
    flagged = flag("z_score", z_threshold)
    return out.select(
        "model", "judge_model", "hf_repo", "bias", "config", "expected_flagged",
        flagged.alias("flagged"), (flagged == F.col("expected_flagged")).alias("match"),
        "z_score", "z_pooled", "num_examples",
        *[F.coalesce(F.col(gamma_column(g)), F.lit(0.0)).alias(gamma_column(g)) for g in gammas],
        F.when(flagged, "YES").otherwise("NO").alias("flagged_label"),
        F.when(F.col("expected_flagged"), "YES").otherwise("NO").alias("expected_label"),
        F.when(flagged == F.col("expected_flagged"), "OK").otherwise("MISS").alias("match_label"))


def run_accuracy(report: DataFrame) -> DataFrame:
    """Per bias and overall (``bias`` null) ``total, correct,
    accuracy`` in one rollup pass; accuracy 0 when there is no run."""
    agg = report.rollup("bias").agg(F.count(F.lit(1)).alias("total"),
                                    F.sum(F.col("match").cast("long")).alias("correct"))
    return agg.select("bias", "total", F.coalesce("correct", F.lit(0)).alias("correct"),
                      F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
                      .otherwise(F.lit(0.0)).alias("accuracy"))


def auto_target(bias: str, trait_names: Sequence[str]) -> str | None:
    """ST16: a partition named after a trait makes that trait the target."""
    return bias if bias in trait_names else None


def auto_target_column(name: Column | str, trait_names: Sequence[str]) -> Column:
    """ST16 on a table of names."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.isin(*trait_names), c)
