"""Per-example trait weights (SC5, SC6, SC7, SC9).

Long form ``(example_id, trait, weight)`` is the primary shape; the wide
matrix is a pivot of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.functions import text as T
from prefscan.operators.ngram import NgramModel, score_tokens


def _as_array(c: str, df: DataFrame) -> Column:
    dtype = df.schema[c].dataType.simpleString()
    return F.col(c) if dtype.startswith("array") else F.array(F.col(c))


def sft_weights_wide(sft: DataFrame, model: NgramModel, tokens_col: str = "resp_tokens", overhead: int = 0,
                     keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """SC7, one row per example: ``(*keys, w_0, w_1, ...)`` in the order of the
    model's conditions, ``(lp_i - lp_base) / max(n + overhead, 1)``."""
    keys = list(keys)
    s = score_tokens(sft, keys, tokens_col, model)
    denom = T.length_denominator(F.col("n_tokens"), overhead=overhead)
    return s.select(*keys, *[((F.col(f"lp_{i}_mean") - F.col("lp_base_mean")) / denom).alias(f"w_{i}")
                             for i in range(len(model.conditions))])


def long_weights(wide: DataFrame, names: dict[str, int], keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """``(*keys, trait, weight)`` of a wide weight table, by projection."""
    entries = [F.struct(F.lit(name).alias("trait"), F.col(f"w_{i}").alias("weight")) for name, i in names.items()]
    return wide.select(*keys, F.inline(F.array(*entries)))


def matrix(wide: DataFrame, names: dict[str, int], keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """SC9: one column per trait of a wide weight table, by projection."""
    return wide.select(*keys, *[F.col(f"w_{i}").alias(name) for name, i in names.items()])


def sft_weights(sft: DataFrame, model: NgramModel, names: dict[str, int], tokens_col: str = "resp_tokens",
                overhead: int = 0, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """SC7: ``(lp_trait - lp_base) / max(n + overhead, 1)`` per example and
    trait.  Returns ``(*keys, trait, weight)``; extra keys that depend on the
    example (language, source) ride along in the same grouping."""
    return long_weights(sft_weights_wide(sft, model, tokens_col, overhead, keys), names, keys)


def preference_weights(pref: DataFrame, model: NgramModel, names: dict[str, int],
                       chosen_tokens: str = "chosen_tokens",
                       rejected_tokens: str = "rejected_tokens", overhead: int = 0) -> DataFrame:
    """SC6: ``(score_c - score_r) / max(len_c + len_r, 1)``; negatives kept.

    Chosen and rejected are scored in one aggregation pivoted by side (J2
    without a self-join)."""
    sides = pref.select("example_id", F.inline(F.array(
        F.struct(F.lit("c").alias("side"), F.col(chosen_tokens).alias("tokens")),
        F.struct(F.lit("r").alias("side"), F.col(rejected_tokens).alias("tokens")))))
    s = score_tokens(sides, ["example_id"], "tokens", model, side="side", sides=["c", "r"])
    denom = T.length_denominator(F.col("n_tokens_c"), F.col("n_tokens_r"), overhead=2 * overhead)
    entries = []
    for name, i in names.items():
        sc = F.col(f"lp_{i}_mean_c") - F.col("lp_base_mean_c")
        sr = F.col(f"lp_{i}_mean_r") - F.col("lp_base_mean_r")
        entries.append(F.struct(F.lit(name).alias("trait"), ((sc - sr) / denom).alias("weight")))
    return s.select("example_id", F.inline(F.array(*entries)))


def candidate_rows(pref: DataFrame) -> DataFrame:
    """One row per candidate of ``chosen``/``rejected`` (strings or arrays):
    ``(example_id, side, idx, text)``, side ``c`` or ``r``, ``idx`` from 0."""
    base = pref.select("example_id", _as_array("chosen", pref).alias("c"), _as_array("rejected", pref).alias("r"))
    cand = base.select("example_id", F.inline(F.array(
        F.struct(F.lit("c").alias("side"), F.col("c").alias("texts")),
        F.struct(F.lit("r").alias("side"), F.col("r").alias("texts")))))
    return cand.select("example_id", "side", F.posexplode("texts").alias("idx", "text"))


def candidate_scores(cand: DataFrame, model: NgramModel, condition: int, truncation: int | None = None,
                     overhead: int = 0) -> DataFrame:
    """``(example_id, side, idx, score, length)`` of ``candidate_rows``.  No text
    is a key or travels with the tokens; ``truncation`` tokens of each candidate
    are scored (``None``: all)."""
    tokens = T.tokens("text") if truncation is None else T.truncate_tokens(T.tokens("text"), truncation)
    scored = score_tokens(cand.select("example_id", "side", "idx", tokens.alias("tokens")),
                          ["example_id", "side", "idx"], "tokens", model)
    return scored.select(
        "example_id", "side", "idx",
        (F.col(f"lp_{condition}_mean") - F.col("lp_base_mean")).alias("score"),
        (F.col("n_tokens") + F.lit(overhead)).cast("int").alias("length"))


def score_candidates(pref: DataFrame, model: NgramModel, condition: int, truncation: int | None = None,
                     overhead: int = 0) -> DataFrame:
    """SC5, the scores only: ``(example_id, chosen_scores, rejected_scores,
    chosen_lengths, rejected_lengths)``, arrays in candidate order as the stored
    format has them."""
    per = candidate_scores(candidate_rows(pref), model, condition, truncation, overhead)
    # one example's candidates form a bounded group of numbers
    grouped = per.groupBy("example_id").agg(
        F.sort_array(F.collect_list(F.struct("side", "idx", "score", "length"))).alias("_c"))

    def pick(side: str, field: str) -> Column:
        return F.transform(F.filter("_c", lambda x: x["side"] == side), lambda x: x[field])

    return grouped.select(
        "example_id", pick("c", "score").alias("chosen_scores"), pick("r", "score").alias("rejected_scores"),
        pick("c", "length").alias("chosen_lengths"), pick("r", "length").alias("rejected_lengths"))


def candidate_texts(pref: DataFrame, truncation: int | None = None) -> DataFrame:
    """``(example_id, prompt, chosen, rejected, truncated_chosen,
    truncated_rejected)``, candidates as arrays."""
    def cut(c: str) -> Column:
        if truncation is None:
            return F.transform(c, lambda x: T.join_tokens(T.tokens(x)))
        return F.transform(c, lambda x: T.join_tokens(T.truncate_tokens(T.tokens(x), truncation)))
    base = pref.select("example_id", "prompt", _as_array("chosen", pref).alias("chosen"),
                       _as_array("rejected", pref).alias("rejected"))
    return base.select("*", cut("chosen").alias("truncated_chosen"), cut("rejected").alias("truncated_rejected"))


def weighted_dataset(pref: DataFrame, model: NgramModel, condition: int, truncation: int | None = None,
                     overhead: int = 0) -> DataFrame:
    """SC5: score every candidate of ``chosen``/``rejected`` (strings or
    arrays), conditioned minus baseline.

    Returns D5: ``example_id, prompt, chosen, rejected, truncated_chosen,
    truncated_rejected, chosen_scores, rejected_scores, chosen_lengths,
    rejected_lengths`` (arrays in candidate order).  Keyword filtering (P5) is
    applied by the caller on the untruncated text before this step.
    """
    scored = score_candidates(pref, model, condition, truncation, overhead)
    return candidate_texts(pref, truncation).join(scored, "example_id")


def to_weight_matrix(weights: DataFrame, trait_names: Sequence[str]) -> DataFrame:
    """SC9 for long weights from elsewhere: one double column per trait."""
    return weights.groupBy("example_id").agg(*[
        F.max(F.when(F.col("trait") == F.lit(t), F.col("weight"))).alias(t) for t in trait_names])


def from_weight_matrix(wide: DataFrame, trait_names: Sequence[str]) -> DataFrame:
    """Wide to long (``stack`` via ``inline``)."""
    entries = [F.struct(F.lit(t).alias("trait"), F.col(f"`{t}`").cast("double").alias("weight"))
               for t in trait_names]
    return wide.select("example_id", F.inline(F.array(*entries)))
