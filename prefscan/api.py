"""User-facing entry points: the selection run, a single detection run and
the detection grid, each composed from the DataFrame operators.

All inputs and outputs are DataFrames; nothing is collected except scalars
(row counts) and the small model metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.functions import text as T
from prefscan.operators import detection, filters, grid, selection, weights
from prefscan.operators.scoring import fit_corpus_model, fit_prompt_model
from prefscan.session import materialize
from prefscan.sources.tables import written_tokens


def background_tokens(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Token arrays of a background corpus (whole texts)."""
    return corpus.select(T.tokens(text_col).alias("tokens"))


def select_pairs(pref: DataFrame, corpus: DataFrame, system_prompt: str, *,
                 filter_words: Sequence[str] | str | None = None, truncation: int | None = None,
                 quantile: float = 0.1, alpha: float = 1.0, lam: float = 0.5, overhead: int = 0,
                 text_col: str = "text") -> DataFrame:
    """SC8 end to end: keyword drop on the full texts (P5), truncation (T3,
    only if asked for),
    scoring with and without the system prompt (SC2), best pair, length and
    max normalisation, top quantile.

    ``pref``: ``(example_id, prompt, chosen, rejected)`` with strings or
    arrays of candidates; ``corpus``: the background texts of the scorer.
    Returns ``(example_id, prompt, chosen, rejected, weight, rank)``.
    """
    kept = filters.drop_if_mentions(pref, filter_words)
    model, names = fit_prompt_model(pref.sparkSession, background_tokens(corpus, text_col),
                                    [("target", system_prompt)], alpha=alpha, lam=lam)
    scored = weights.candidate_scores(weights.candidate_rows(kept), model, names["target"], truncation, overhead)
    return selection.select_top_pairs(scored, quantile, weights.candidate_texts(kept, truncation))


def cut_tokens(text: str, truncation: int | None) -> Column:
    """T3 if asked for; otherwise all tokens."""
    return T.tokens(text) if truncation is None else T.truncate_tokens(T.tokens(text), truncation)


def trait_weights(data: DataFrame, corpus: DataFrame, traits: Sequence[tuple[str, str]], *,
                  mode: str = "sft", truncation: int | None = None, alpha: float = 1.0, lam: float = 0.5,
                  overhead: int = 0, text_col: str = "text") -> DataFrame:
    """ST2 first half: per-example weights for every (name, system prompt)
    trait, in one scoring pass over whole responses (``truncation``: the first
    tokens only).  ``data``: ``(example_id, prompt, response)`` for SFT or
    ``(example_id, prompt, chosen, rejected)`` for preference; ``overhead``: tokens
    the chat template adds to a response (``templates.completion_overhead``).
    Returns the long table ``(example_id, trait, weight)``, written once."""
    model, names = fit_prompt_model(data.sparkSession, background_tokens(corpus, text_col), list(traits),
                                    alpha=alpha, lam=lam)
    if mode == "sft":
        sft = data.select("example_id", cut_tokens("response", truncation).alias("resp_tokens"))
        return weights.long_weights(materialize(weights.sft_weights_wide(sft, model, overhead=overhead)), names)
    if mode == "preference":
        pref = data.select("example_id", cut_tokens("chosen", truncation).alias("chosen_tokens"),
                           cut_tokens("rejected", truncation).alias("rejected_tokens"))
        return materialize(weights.preference_weights(pref, model, names, overhead=overhead))
    raise ValueError(f"unknown mode: {mode}")


def corpus_trait_weights(docs: DataFrame, key: str, values: Sequence[str], *, truncation: int | None = None,
                         alpha: float = 1.0, lam: float = 0.5, overhead: int = 0, text_col: str = "text",
                         id_col: str = "doc_id") -> DataFrame:
    """Weights of documents under corpus traits (the documents whose ``key``
    equals each value); the response is the whole text.  The texts are split
    once, into a written table that the model and the scores read."""
    split = docs.select(F.col(id_col).alias("example_id"), key, T.tokens(text_col).alias("resp_tokens"))
    doc = written_tokens(split, ["example_id", key], "resp_tokens")
    model, names = fit_corpus_model(doc, key, values, alpha=alpha, lam=lam, tokens_col="resp_tokens")
    sft = doc if truncation is None else doc.withColumn("resp_tokens", T.truncate_tokens(F.col("resp_tokens"), truncation))
    return weights.long_weights(materialize(weights.sft_weights_wide(sft, model, overhead=overhead)), names)


def detect(weights_long: DataFrame, target: str, controls: Sequence[str],
           system_prompts: dict[str, str] | None = None, *, z_threshold: float = detection.Z_THRESHOLD,
           gammas: Sequence[float] = detection.DETECT_GAMMAS, fields: dict | None = None) -> DataFrame:
    """ST1 / ST2: the nested detection report (D9); ``fields`` (say
    ``dataset_path``, ``judge_model``) stand at its top."""
    wr = detection.assign_roles(weights_long, target, controls)
    spark = weights_long.sparkSession
    prompts = spark.createDataFrame(
        [(t, (system_prompts or {}).get(t, "")) for t in [target, *controls]],
        "trait string, system_prompt string")
    report = detection.detection_report(wr, prompts, (), gammas, z_threshold)
    return report.select(*[F.lit(v).cast("string").alias(k) for k, v in (fields or {}).items()], "*")


def detection_grid(weights_by_model: DataFrame, cfg: grid.GridConfig, datasets: DataFrame | None = None,
                   available: DataFrame | None = None) -> DataFrame:
    """ST17: every run of a grid.  ``weights_by_model``: ``(model, config,
    example_id, trait, weight)``; ``datasets``: the bias/dataset listing
    (defaults to the configuration's lists); ``available``: the catalog of
    configs for the fail-fast check (skipped when absent)."""
    spark = weights_by_model.sparkSession
    ds = datasets if datasets is not None else grid.datasets_df(spark, cfg)
    if available is not None:
        grid.validate(spark, cfg, available, ds)
    runs = grid.fan_out(spark, cfg, ds)
    w = weights_by_model
    cap = cfg.dataset_defaults.get("max_examples")
    if cap is not None:
        # the same examples for every trait of a dataset: cap the ids, then
        # keep the weights of the kept ids (a key join, no broadcast assumed)
        ids = w.select("model", "config", "example_id").distinct()
        kept = filters.cap_examples_per_group(ids, int(cap), ["model", "config"])
        w = w.join(kept, ["model", "config", "example_id"], "left_semi")
    return grid.grid_report(w, runs, grid.bias_roles(spark, cfg), cfg.z_threshold)
