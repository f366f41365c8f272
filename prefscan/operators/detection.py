"""Detection statistics (ST1, ST2, ST12, ST14; A2-A6).

Input is the long weight table with roles:
``(*run_keys, example_id, trait, role, weight)``, ``role`` in
{'target', 'control'}.  ``run_keys`` identify one detection run (empty for a
single run; ``model, dataset, bias`` for the grid), so every run of a grid is
computed by the same grouped plan, never by a driver loop.

z rule (A6):   sd > 0 -> (t - m) / sd; else +inf when t > m, else 0.0
tail rule (A6b): sd > 0 -> (t - m) / sd; else +inf
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.operators.filters import flag
from prefscan.operators.ranks import order_statistics
from prefscan.session import materialize

# The tail fractions of the detection report and the tail report.
DETECT_GAMMAS = (0.05, 0.1, 0.2)
TAIL_GAMMAS = (0.01, 0.05, 0.10, 0.20)
Z_THRESHOLD = 3.0

INF = float("inf")


def gamma_column(g: float) -> str:
    """``z_top_0_05`` for 0.05."""
    return "z_top_" + str(g).replace(".", "_")


def _spread(sd: Column) -> Column:
    """A usable deviation: above zero and a number (Spark orders NaN above all
    numbers, so a comparison alone would let it through)."""
    return (sd > 0) & ~F.isnan(sd)


def z_rule(t: Column, m: Column, sd: Column) -> Column:
    """A6."""
    return (F.when(_spread(sd), (t - m) / sd)
            .when((t > m) & ~F.isnan(t) & ~F.isnan(m), F.lit(INF)).otherwise(F.lit(0.0)))


def z_rule_tail(t: Column, m: Column, sd: Column) -> Column:
    """A6b."""
    return F.when(_spread(sd), (t - m) / sd).otherwise(F.lit(INF))


def assign_roles(weights: DataFrame, target: str, controls: Sequence[str]) -> DataFrame:
    """P10 for a single run: keep the target and the listed controls."""
    controls = list(controls)
    return (weights.where(F.col("trait").isin([target, *controls]))
            .withColumn("role", F.when(F.col("trait") == target, F.lit("target"))
                        .otherwise(F.lit("control"))))


def moments(wr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``: ``n, mean_weight, std_weight`` (sample) and
    ``var_pop``.  All z-scores of a run follow from this table, so the weights
    are read once; it holds a few numbers per trait and is written."""
    return materialize(wr.groupBy(*keys).agg(
        F.count("weight").alias("n"), F.avg("weight").alias("mean_weight"),
        F.stddev_samp("weight").alias("std_weight"), F.var_pop("weight").alias("var_pop")))


def trait_stats(wr: DataFrame, run_keys: Sequence[str] = ()) -> DataFrame:
    """A2: ``(*run, trait, role, n, mean_weight, std_weight)``; std of one
    value is null (numpy gives NaN)."""
    return moments(wr, [*run_keys, "trait", "role"])


def z_means(wr: DataFrame | None, run_keys: Sequence[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """A3 + A6: target mean against the mean and sample std of the control
    means."""
    ts = stats if stats is not None else trait_stats(wr, run_keys)
    is_t = F.col("role") == "target"
    out = ts.groupBy(*run_keys).agg(
        F.max(F.when(is_t, F.col("n"))).alias("num_examples"),
        F.max(F.when(is_t, F.col("mean_weight"))).alias("target_mean"),
        F.avg(F.when(~is_t, F.col("mean_weight"))).alias("control_mean"),
        F.stddev_samp(F.when(~is_t, F.col("mean_weight"))).alias("control_std"))
    return out.withColumn("z_score", z_rule(F.col("target_mean"), F.col("control_mean"),
                                            F.col("control_std")))


def z_pooled(wr: DataFrame | None, run_keys: Sequence[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """A4 + A6: target mean against all control rows pooled; the pooled
    moments are merged from the traits' moments."""
    run_keys = list(run_keys)
    ts = stats if stats is not None else trait_stats(wr, run_keys)
    is_t = F.col("role") == "target"
    n, m = F.col("n").cast("double"), F.col("mean_weight")
    mid = ts.groupBy(*run_keys).agg(
        F.max(F.when(is_t, m)).alias("target_mean"),
        (F.sum(F.when(~is_t, n * m)) / F.sum(F.when(~is_t, n))).alias("pooled_mean"),
        F.coalesce(F.sum(F.when(~is_t, F.col("n"))), F.lit(0)).alias("pooled_n"))
    # a few rows per run on both sides
    back = ts.join(mid, run_keys) if run_keys else ts.crossJoin(mid)
    sq = back.groupBy(*run_keys, "target_mean", "pooled_mean", "pooled_n").agg(F.sum(F.when(
        ~is_t, n * (F.col("var_pop") + F.pow(m - F.col("pooled_mean"), F.lit(2.0))))).alias("_sq"))
    out = sq.select(*run_keys, "target_mean", "pooled_mean", F.when(
        F.col("pooled_n") > 1, F.sqrt(F.col("_sq") / (F.col("pooled_n") - 1))).alias("pooled_std"), "pooled_n")
    return out.withColumn("z_pooled", z_rule(F.col("target_mean"), F.col("pooled_mean"),
                                             F.col("pooled_std")))


def _top_means(weights: DataFrame | Callable, stats: DataFrame, run_keys: Sequence[str], gammas: Sequence[float],
               data_keys: Sequence[str]) -> DataFrame:
    """Per (run, trait): mean of the k largest weights for every gamma, with
    ``k = max(int(n * gamma), 1)`` and ``n`` the run's number of target rows.

    ``weights`` carry ``data_keys`` (those of the run that its rows depend on);
    a trait's tail is found once however many runs ask for it.  A function in
    their place gives the order statistics itself (say, from stored state)."""
    run_keys, data_keys = list(run_keys), list(data_keys)
    n = stats.groupBy(*run_keys).agg(F.max(F.when(F.col("role") == "target", F.col("n"))).alias("_n")).where("_n > 0")
    g = stats.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(gammas)], "_g int, _gamma double")
    ks = n.crossJoin(F.broadcast(g)).select(
        *run_keys, "_g", F.greatest(F.floor(F.col("_n").cast("double") * F.col("_gamma")), F.lit(1)).alias("_k"))
    of = stats.select(*run_keys, "trait", "role", F.col("n").alias("_have"))
    asked = of.join(ks, run_keys) if run_keys else of.crossJoin(F.broadcast(ks))
    asked = materialize(asked.withColumn("_take", F.least("_k", "_have")).withColumn(
        "p", F.col("_have") - F.col("_take") + 1))
    key = [*data_keys, "trait"]
    want = asked.select(*key, "p")
    got = weights(want) if callable(weights) else order_statistics(weights, "weight", want, key)
    return asked.join(got, [*key, "p"]).groupBy(*run_keys, "trait", "role").agg(*[
        F.max(F.when(F.col("_g") == i, F.col("upper_sum") / F.col("_take"))).alias(f"_m_{i}")
        for i in range(len(gammas))], *[F.max(F.when(F.col("_g") == i, F.col("_k"))).alias(f"_kk_{i}")
                                        for i in range(len(gammas))])


def z_top_gamma(wr: DataFrame, run_keys: Sequence[str] = (),
                gammas: Sequence[float] = DETECT_GAMMAS, tail_rule: bool = False,
                stats: DataFrame | None = None, data_keys: Sequence[str] | None = None) -> DataFrame:
    """A5 + A6 (or A6b): ``(*run, gamma, k, target_topk_mean,
    control_topk_mean, control_topk_std, z_score)``."""
    run_keys = list(run_keys)
    ts = stats if stats is not None else trait_stats(wr, run_keys)
    tm = _top_means(wr, ts, run_keys, gammas, run_keys if data_keys is None else data_keys)
    is_t = F.col("role") == "target"
    aggs = []
    for i in range(len(gammas)):
        aggs += [F.max(f"_kk_{i}").alias(f"k_{i}"),
                 F.max(F.when(is_t, F.col(f"_m_{i}"))).alias(f"t_{i}"),
                 F.avg(F.when(~is_t, F.col(f"_m_{i}"))).alias(f"c_{i}"),
                 F.stddev_samp(F.when(~is_t, F.col(f"_m_{i}"))).alias(f"s_{i}")]
    per = tm.groupBy(*run_keys).agg(*aggs)
    rule = z_rule_tail if tail_rule else z_rule
    entries = [F.struct(F.lit(float(g)).alias("gamma"), F.col(f"k_{i}").cast("long").alias("k"),
                        F.col(f"t_{i}").alias("target_topk_mean"),
                        F.col(f"c_{i}").alias("control_topk_mean"),
                        F.col(f"s_{i}").alias("control_topk_std"),
                        rule(F.col(f"t_{i}"), F.col(f"c_{i}"), F.col(f"s_{i}")).alias("z_score"))
               for i, g in enumerate(gammas)]
    return per.select(*run_keys, F.inline(F.array(*entries)))


def detection_summary(wr: DataFrame, run_keys: Sequence[str] = (),
                      gammas: Sequence[float] = DETECT_GAMMAS,
                      z_threshold: float = Z_THRESHOLD, stats: DataFrame | None = None,
                      data_keys: Sequence[str] | None = None) -> DataFrame:
    """ST1 flat: one row per run with the three z-scores and the flag.
    ``stats`` and ``data_keys``: moments already joined with the runs' roles,
    and the keys of ``wr`` itself (a grid)."""
    run_keys = list(run_keys)
    ts = stats if stats is not None else trait_stats(wr, run_keys)
    zm = z_means(None, run_keys, ts)
    zp = z_pooled(None, run_keys, ts).drop("target_mean")
    zt = z_top_gamma(wr, run_keys, gammas, stats=ts, data_keys=data_keys)
    piv = zt.groupBy(*run_keys).agg(*[
        F.max(F.when(F.col("gamma") == F.lit(float(g)), F.col("z_score"))).alias(gamma_column(g))
        for g in gammas])
    # one row per run on every side: run-keyed joins, or one-row products
    out = zm.join(zp, run_keys) if run_keys else zm.crossJoin(F.broadcast(zp))
    out = out.join(piv, run_keys, "left") if run_keys else out.join(F.broadcast(piv), F.lit(True), "left")
    return out.withColumn("flagged", flag("z_score", z_threshold))


def detection_report(wr: DataFrame, system_prompts: DataFrame, run_keys: Sequence[str] = (),
                     gammas: Sequence[float] = DETECT_GAMMAS,
                     z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """ST1 / D9 nested: ``num_examples``, ``traits`` map of structs,
    ``detection`` struct with a ``quantile_analysis`` map; one row per run.
    ``system_prompts``: ``(trait, system_prompt)``."""
    run_keys = list(run_keys)
    stats = trait_stats(wr, run_keys)
    ts = stats.join(F.broadcast(system_prompts), "trait", "left")
    traits = ts.groupBy(*run_keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "trait", F.struct("system_prompt", (F.col("role") == "target").alias("is_target"),
                          "mean_weight", "std_weight")))).alias("traits"))
    zt = z_top_gamma(wr, run_keys, gammas, stats=stats)
    qa = zt.groupBy(*run_keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("top_"), F.col("gamma").cast("string")),
        F.struct("k", "target_topk_mean", "control_topk_mean", "control_topk_std", "z_score")
    ))).alias("quantile_analysis"))
    zm = z_means(None, run_keys, stats)
    zp = z_pooled(None, run_keys, stats).drop("target_mean")

    def j(a, b):
        return a.join(b, run_keys) if run_keys else a.crossJoin(F.broadcast(b))

    out = j(j(j(zm, zp), qa), traits)
    det = F.struct("target_mean", "control_mean", "control_std", "z_score", "z_pooled",
                   "pooled_std", "pooled_n", F.lit(float(z_threshold)).alias("z_threshold"),
                   flag("z_score", z_threshold).alias("flagged"), "quantile_analysis")
    return out.select(*run_keys, "num_examples", "traits", det.alias("detection"),
                      F.lit(float(z_threshold)).alias("z_threshold"),
                      flag("z_score", z_threshold).alias("flagged"))


def trait_bars(wr: DataFrame, run_keys: Sequence[str] = (),
               z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """ST14: the table behind the bar chart (trait, mean, std, is_target,
    run z-score, flagged)."""
    run_keys = list(run_keys)
    ts = trait_stats(wr, run_keys)
    zm = z_means(wr, run_keys, stats=ts).select(*run_keys, "z_score")
    out = ts.join(zm, run_keys) if run_keys else ts.crossJoin(F.broadcast(zm))
    return out.select(*run_keys, "trait", "mean_weight", "std_weight",
                      (F.col("role") == "target").alias("is_target"), "z_score",
                      flag("z_score", z_threshold).alias("flagged"))
