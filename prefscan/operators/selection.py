"""Selection of the strongest pairs (SC8) and its parts: best candidate pair (WN3/J8),
positive filter (P6), length and max normalisation (A7), quantile report (A8)
and top quantile (T1).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.operators.ranks import distributed_rank, order_statistics
from prefscan.session import materialize, small

# The quantiles printed by the selection report.
REPORT_QUANTILES = (0.25, 0.30, 0.40, 0.45, 0.50, 0.75, 0.78, 0.80, 0.85, 0.90,
                    0.95, 0.96, 0.97, 0.98, 0.99)


def _no_nan(arr: str) -> Column:
    return F.transform(arr, lambda x: F.when(~F.isnan(x), x))


def best_candidate_pair(df: DataFrame, chosen_scores: str = "chosen_scores",
                        rejected_scores: str = "rejected_scores") -> DataFrame:
    """WN3 / J8 without enumerating pairs.

    The best pair maximises ``c_i - r_j``; that maximum is ``max(c) - min(r)``
    (subtraction is monotone, also in floating point).  Ties go to the lowest
    chosen index, then the lowest rejected index, as in a strict ``>`` scan
    starting from 0.  NaN scores never win.  Adds ``best_w, i_c, i_r``
    (0-based; ``best_w`` null when no finite pair exists).
    """
    cs = _no_nan(chosen_scores)
    rs = _no_nan(rejected_scores)
    out = df.withColumn("_cs", cs).withColumn("_rs", rs)
    out = out.withColumn("_minr", F.array_min("_rs"))
    out = out.withColumn("best_w", F.array_max("_cs") - F.col("_minr"))
    out = out.withColumn(
        "_ic", F.array_position(F.transform("_cs", lambda x: (x - F.col("_minr")) == F.col("best_w")),
                                F.lit(True)))
    best_c = F.when(F.col("_ic") > 0, F.try_element_at("_cs", F.greatest(F.col("_ic"), F.lit(1)).cast("int")))
    out = out.withColumn(
        "_ir", F.array_position(F.transform("_rs", lambda y: (best_c - y) == F.col("best_w")), F.lit(True)))
    found = F.col("best_w").isNotNull() & (F.col("_ic") > 0) & (F.col("_ir") > 0)
    return (out.withColumn("i_c", F.when(found, (F.col("_ic") - 1).cast("int")))
            .withColumn("i_r", F.when(found, (F.col("_ir") - 1).cast("int")))
            .drop("_cs", "_rs", "_minr", "_ic", "_ir"))


def best_pairs(rows: DataFrame) -> DataFrame:
    """WN3 / J8 from one row per candidate: ``(example_id, side, idx, score,
    length)``, side ``c`` or ``r``, ``idx`` any number that orders a side.

    One aggregate that merges on the map side, so an example with any number of
    candidates costs a task one row: the greatest ``(score, -idx)`` of the
    chosen and the least ``(score, idx)`` of the rejected.  Equal scores go to the
    lowest ``idx``; NaN and null scores never win.  Returns ``(example_id, i_c,
    i_r, best_w, len_c, len_r)`` of the examples that have both sides."""
    fine = F.col("score").isNotNull() & ~F.isnan("score")

    def of(side: str, order: Column) -> Column:
        return F.when(fine & (F.col("side") == side), F.struct("score", order.alias("order"), "idx", "length"))
    best = rows.groupBy("example_id").agg(F.max(of("c", -F.col("idx"))).alias("c"), F.min(of("r", F.col("idx"))).alias("r"))
    return best.where(F.col("c").isNotNull() & F.col("r").isNotNull()).select(
        "example_id", F.col("c.idx").alias("i_c"), F.col("r.idx").alias("i_r"),
        (F.col("c.score") - F.col("r.score")).alias("best_w"), F.col("c.length").alias("len_c"), F.col("r.length").alias("len_r"))


def ordinals(best: DataFrame, rows: DataFrame) -> DataFrame:
    """``best`` with ``i_c`` and ``i_r`` counted within their side (from 0)
    instead of the order numbers of ``rows`` ``(example_id, side, idx)``: the
    candidates of the side before them are counted, with partial counts."""
    own = best.select("example_id", F.col("i_c").alias("_c"), F.col("i_r").alias("_r"))
    near = rows.select("example_id", "side", "idx").join(small(own, 64), "example_id")
    place = near.groupBy("example_id").agg(
        F.count_if((F.col("side") == "c") & (F.col("idx") < F.col("_c"))).cast("int").alias("i_c"),
        F.count_if((F.col("side") == "r") & (F.col("idx") < F.col("_r"))).cast("int").alias("i_r"))
    return best.drop("i_c", "i_r").join(small(place, 64), "example_id")


def positive_pairs(scored: DataFrame) -> DataFrame:
    """WN3 + P6 + length normalisation: one row per example whose best pair
    has ``w > 0``: ``example_id, i_c, i_r, w, len_c, len_r, w_len``.  ``scored``
    has one row per candidate (``best_pairs``), or the arrays of D5."""
    if "side" in scored.columns:
        b = best_pairs(scored)
    else:
        b = best_candidate_pair(scored).withColumns({
            "len_c": F.try_element_at("chosen_lengths", F.col("i_c") + 1),
            "len_r": F.try_element_at("rejected_lengths", F.col("i_r") + 1)})
    b = b.where(F.col("best_w").isNotNull() & (F.col("best_w") > 0))
    return b.select(
        "example_id", "i_c", "i_r", F.col("best_w").alias("w"), "len_c", "len_r",
        (F.col("best_w") / F.greatest(F.col("len_c") + F.col("len_r"), F.lit(1)).cast("double")).alias("w_len"))


def normalise_by_max(df: DataFrame, col: str = "w_len", out: str = "weight") -> DataFrame:
    """Divide by the dataset maximum (a one-row aggregate, broadcast).
    ``df`` is read twice: hand in a written frame."""
    mx = df.agg(F.max(col).alias("_max"))
    return df.crossJoin(F.broadcast(mx)).withColumn(out, F.col(col) / F.col("_max")).drop("_max")


def top_quantile(df: DataFrame, quantile: float, weight: str = "weight", id_col: str = "example_id") -> DataFrame:
    """Keep ``ceil(q * n)`` rows by weight descending (ties by id), with a
    1-based ``rank``.  Only ids and weights are sorted, by a distributed rank
    that no single task holds; the kept rows' other columns return by key."""
    k = math.ceil(float(quantile) * df.count())
    slim = df.select(id_col, weight)
    ranked = distributed_rank(slim, [F.col(weight).desc(), F.col(id_col).asc()], "rank").where(F.col("rank") <= k)
    return ranked.select(id_col, "rank").join(df, id_col)


def positive_weights(scored: DataFrame) -> DataFrame:
    """Positive pairs with their normalised weight: one row of numbers each,
    written once."""
    return normalise_by_max(materialize(positive_pairs(scored)))


def select_top_pairs(scored: DataFrame, quantile: float, texts: DataFrame | None = None) -> DataFrame:
    """SC8: ``(example_id, prompt, chosen, rejected, weight, rank)``; empty in,
    empty out.  Only numbers are scored, ranked and written; ``texts`` (see
    ``weights.candidate_texts``; ``scored`` itself when it carries them) join
    the kept rows alone."""
    top = top_quantile(positive_weights(scored), quantile)
    words = (scored if texts is None else texts).select(
        "example_id", "prompt", "truncated_chosen", "truncated_rejected")
    return top.join(words, "example_id").select(
        "example_id", "prompt",
        F.try_element_at("truncated_chosen", F.col("i_c") + 1).alias("chosen"),
        F.try_element_at("truncated_rejected", F.col("i_r") + 1).alias("rejected"), "weight", "rank")


def quantile_report(df: DataFrame, weight: str = "weight", id_col: str = "example_id",
                    quantiles: Sequence[float] = REPORT_QUANTILES) -> DataFrame:
    """Lower-nearest quantiles ``ws[int(p (n-1))]`` plus ``smallest``
    (``p = 1/n``).  Returns ``(label, p, value)``.  The rows are counted in
    ranges and only the ranges that hold a wanted position are ranked; equal
    weights are one value, so no id is needed.  ``df`` is read more than once:
    hand in a written frame."""
    spark = df.sparkSession
    base = df.select(F.col(weight).cast("double").alias("_w"))
    n = base.agg(F.count("_w").alias("_n"))
    ps = spark.createDataFrame([(f"{int(round(p * 100))}%", float(p)) for p in quantiles],
                               "label string, p double")
    want = ps.crossJoin(F.broadcast(n)).unionByName(
        n.select(F.lit("smallest").alias("label"), (F.lit(1.0) / F.greatest("_n", F.lit(1))).alias("p"), "_n"))
    want = materialize(want.where(F.col("_n") > 0).withColumn(
        "_r", (F.floor(F.col("p") * (F.col("_n") - 1).cast("double")) + 1).cast("long")))
    found = order_statistics(base, "_w", want.select(F.col("_r").alias("p"))).select(F.col("p").alias("_r"), "value")
    return want.join(F.broadcast(found), "_r").select("label", "p", "value")  # 16 rows
