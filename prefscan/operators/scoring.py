"""Scoring contract and the scorers other than the n-gram model.

Contract (long form): ``(example_id, side, idx, condition, lp_mean, lp_sum,
n_tokens)`` with ``condition = ''`` as the baseline.

SC1  score_lookup   log-probs computed elsewhere, joined by key
SC3  score_batch    a user scorer over Arrow batches (``mapInPandas``)
SC4  score_delta    conditioned minus baseline, one conditional aggregate
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.functions import text as T
from prefscan.operators.ngram import NgramModel, fit_corpus_ngram, fit_ngram, score_tokens


def prompt_conditions(spark: SparkSession, traits: Sequence[tuple[str, str]]
                      ) -> tuple[DataFrame, list[str], dict[str, int]]:
    """Condition tokens for prompt-text traits.

    Identical system prompts under two names are scored once: the condition
    key is the prompt text, and every trait name maps to its text's column.
    """
    texts: list[str] = []
    mapping: dict[str, int] = {}
    for name, text in traits:
        if text not in texts:
            texts.append(text)
        mapping[name] = texts.index(text)
    df = spark.createDataFrame([(t,) for t in texts], "condition string")
    return df.select("condition", T.tokens("condition").alias("tokens")), texts, mapping


def long_scores(scored: DataFrame, keys: Sequence[str], model: NgramModel,
                names: dict[str, int]) -> DataFrame:
    """Scored wide rows to the long contract (baseline under ``''``)."""
    entries = [F.struct(F.lit("").alias("condition"), F.col("lp_base_mean").alias("lp_mean"),
                        F.col("lp_base_sum").alias("lp_sum"))]
    for name, i in names.items():
        entries.append(F.struct(F.lit(name).alias("condition"), F.col(f"lp_{i}_mean").alias("lp_mean"),
                                F.col(f"lp_{i}_sum").alias("lp_sum")))
    return scored.select(*keys, "n_tokens", F.inline(F.array(*entries)))


def score_delta(long_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SC4 / J1: ``lp(condition) - lp('')`` per key, in one grouping: a key's
    conditions (config-sized) are gathered next to its baseline."""
    keys = list(keys)
    per = long_df.groupBy(*keys).agg(
        F.max(F.when(F.col("condition") == "", F.col("lp_mean"))).alias("_base"),
        F.collect_list(F.when(F.col("condition") != "", F.struct("condition", "lp_mean"))).alias("_c"))
    return per.select(*keys, "_base", F.inline("_c")).select(
        *keys, "condition", (F.col("lp_mean") - F.col("_base")).alias("score"))


def score_lookup(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SC1: precomputed ``(keys, condition, lp_mean)`` rows joined to the
    requests; missing scores stay null."""
    return requests.join(table, list(keys), "left")


BATCH_TOKENS = 1 << 16


def token_batches(rows: pd.DataFrame, most: int):
    """``rows`` by size, cut so that rows times the longest stays within ``most``."""
    size = [len(p.split()) + len(r.split()) for p, r in zip(rows["prompt"].fillna(""), rows["response"].fillna(""))]
    order = sorted(range(len(size)), key=lambda i: (size[i], i))
    start = 0
    for i, at in enumerate(order):  # ascending: the newest is the longest
        if i > start and (i + 1 - start) * size[at] > most:
            yield rows.iloc[order[start:i]]
            start = i
    if start < len(order):
        yield rows.iloc[order[start:]]


def score_batch(pairs: DataFrame, conditions: DataFrame,
                scorer: Callable[[list[str], list[str], str], list[float]],
                keys: Sequence[str] = ("example_id",), partitions: int | None = None,
                profile=None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """SC3: apply ``scorer(prompts, responses, system_prompt) -> floats`` to
    Arrow batches.

    ``pairs``: ``(keys, prompt, response)``; ``conditions``: ``(condition,
    system_prompt)``, a config-sized table, with the baseline ``('', '')`` added.
    The scorer is loaded once per task and meets every condition there.  Rows
    are spread by response length, and a task cuts its rows, shortest first, into
    batches whose padded size (rows times the longest prompt and response, in
    words) stays within ``batch_tokens``; a longer text is a batch of its own.  ``profile``: an
    optional ``pyspark.resource.ResourceProfile`` (e.g. one GPU per task) for
    the scoring stage only.
    """
    keys = list(keys)
    conds = [("", "")] + [(r["condition"], r["system_prompt"]) for r in conditions.select(
        "condition", "system_prompt").collect()]  # the traits of the config
    work = pairs.select(*keys, "prompt", "response")
    # texts of like length in one batch; every text is shuffled once, not once a condition
    order = [F.length("response"), *keys]
    work = work.repartitionByRange(partitions, *order) if partitions else work.repartitionByRange(*order)
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.schema.fields if f.name in keys)
    out_schema += ", condition string, lp_mean double"

    def run(batches):
        for b in (own for part in batches for own in token_batches(part, batch_tokens)):
            prompts, responses = b["prompt"].tolist(), b["response"].tolist()
            parts, done = [], {}
            for name, sp in conds:
                if sp not in done:  # equal system prompts are scored once
                    done[sp] = scorer(prompts, responses, sp)
                parts.append(b[keys].assign(condition=name, lp_mean=pd.Series(done[sp], index=b.index, dtype="float64")))
            yield pd.concat(parts)

    if profile is not None:
        return work.mapInPandas(run, out_schema, profile=profile)
    return work.mapInPandas(run, out_schema)


def fit_prompt_model(spark: SparkSession, background: DataFrame,
                     traits: Sequence[tuple[str, str]], alpha: float = 1.0,
                     lam: float = 0.5) -> tuple[NgramModel, dict[str, int]]:
    cond, texts, mapping = prompt_conditions(spark, traits)
    return fit_ngram(background, cond, texts, alpha=alpha, lam=lam), mapping


def fit_corpus_model(background: DataFrame, key: str, values: Sequence[str],
                     alpha: float = 1.0, lam: float = 0.5, lams: Sequence[float] | None = None,
                     tokens_col: str = "tokens") -> tuple[NgramModel, dict[str, int]]:
    """Corpus traits: condition ``v`` is the background documents with
    ``key == v``; fitted in a single aggregation pass."""
    values = list(values)
    model = fit_corpus_ngram(background, key, values, alpha=alpha, lam=lam, tokens_col=tokens_col, lams=lams)
    return model, {v: i for i, v in enumerate(values)}


__all__ = ["prompt_conditions", "long_scores", "score_delta",
           "score_lookup", "score_batch", "fit_prompt_model", "fit_corpus_model", "score_tokens"]
