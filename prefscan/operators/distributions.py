"""Distribution comparison of target and control weights (ST7-ST11).

Input: the long table with roles ``(example_id, trait, role, weight)`` of a
single run.  Every global order goes through ``distributed_rank`` /
``distributed_cumsum``; ties are merged by grouping on the value first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType
from pyspark.sql import functions as F

from prefscan.operators.ranks import distributed_cumsum, distributed_rank, exact_percentiles
from prefscan.session import materialize

# 80 histogram edges (79 bins) between the 1st and 99th
# percentile of target and controls together.
HIST_EDGES = 80
HIST_LOW_P = 0.01
HIST_HIGH_P = 0.99


def pooled_series(wr: DataFrame) -> DataFrame:
    """``(series, example_id, weight)`` with series 'target' or 'pooled'."""
    return wr.select(F.when(F.col("role") == "target", F.lit("target"))
                     .otherwise(F.lit("pooled")).alias("series"), "example_id", "weight")


def trait_histogram(wr: DataFrame) -> DataFrame:
    """ST7 / A10: density histogram of target vs pooled controls.

    Returns ``(series, bin, bin_lo, bin_hi, count, density)`` for all 79 bins
    of both series (empty bins have count 0)."""
    spark = wr.sparkSession
    ps = exact_percentiles(wr, "weight", [HIST_LOW_P, HIST_HIGH_P])
    bounds = ps.agg(F.max(F.when(F.col("p") == HIST_LOW_P, F.col("value"))).alias("lo"),
                    F.max(F.when(F.col("p") == HIST_HIGH_P, F.col("value"))).alias("hi"))
    nb = HIST_EDGES - 1
    bounds = bounds.withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(float(nb)))
    s = pooled_series(wr).crossJoin(F.broadcast(bounds))
    inside = s.where((F.col("weight") >= F.col("lo")) & (F.col("weight") <= F.col("hi")))
    guess = F.least(F.coalesce(F.floor(F.try_divide(F.col("weight") - F.col("lo"), F.col("width"))),
                               F.lit(nb - 1)), F.lit(nb - 1))
    inside = inside.withColumn("_b", guess.cast("int"))
    # the edges decide, as in a search among them: the quotient can miss by one
    below = F.col("weight") < F.col("lo") + F.col("_b") * F.col("width")
    above = (F.col("weight") >= F.col("lo") + (F.col("_b") + 1) * F.col("width")) & (F.col("_b") < nb - 1)
    binned = inside.withColumn("bin", F.when(below, F.col("_b") - 1).when(above, F.col("_b") + 1).otherwise(F.col("_b")))
    counts = binned.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("count"))
    n_in = binned.groupBy("series").agg(F.count(F.lit(1)).alias("n_in"))
    grid = (spark.createDataFrame([("target",), ("pooled",)], "series string")
            .crossJoin(F.broadcast(spark.range(nb).select(F.col("id").cast("int").alias("bin"))))
            .crossJoin(F.broadcast(bounds)))
    out = (grid.join(counts, ["series", "bin"], "left").join(n_in, "series", "left")
           .withColumn("count", F.coalesce("count", F.lit(0)).cast("long")))
    return out.select(
        "series", "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        "count",
        F.try_divide(F.col("count").cast("double"),
                     F.col("n_in").cast("double") * F.col("width")).alias("density"))


def trait_ccdf(wr: DataFrame) -> DataFrame:
    """ST8 / WN5: per trait ``(trait, i, value, ccdf = 1 - i/n)``, ascending,
    ties not merged."""
    ranked = distributed_rank(wr.select("trait", "example_id", "weight"),
                              [F.col("weight").asc(), F.col("example_id").asc()], "i", ["trait"])
    n = wr.groupBy("trait").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(n), "trait").select(
        "trait", "i", F.col("weight").alias("value"),
        (F.lit(1.0) - F.col("i").cast("double") / F.col("_n").cast("double")).alias("ccdf"))


def median_shift(wr: DataFrame) -> DataFrame:
    """ST11: medians of target and pooled controls and their difference."""
    med = exact_percentiles(pooled_series(wr), "weight", [0.5], ["series"])
    return med.agg(F.max(F.when(F.col("series") == "target", F.col("value"))).alias("target_median"),
                   F.max(F.when(F.col("series") == "pooled", F.col("value"))).alias("control_median")
                   ).withColumn("shift", F.col("target_median") - F.col("control_median"))


def _value_counts(wr: DataFrame) -> DataFrame:
    """``(trait, role, value, n)``: equal weights merged before any fan-out."""
    return wr.groupBy("trait", "role", F.col("weight").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _pooled(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.lit("pooled").alias("against"), "value").agg(
        F.sum(F.when(F.col("role") == "target", F.col("n")).otherwise(0)).alias("nt"),
        F.sum(F.when(F.col("role") == "control", F.col("n")).otherwise(0)).alias("nc"))


def _comparisons(wr: DataFrame) -> DataFrame:
    """``(against, value, nt, nc)``: target vs each control, and vs pooled."""
    counts = materialize(_value_counts(wr))
    t = counts.where(F.col("role") == "target").groupBy("value").agg(F.sum("n").alias("nt"))
    c = counts.where(F.col("role") == "control")
    controls = c.select(F.col("trait").alias("against")).distinct()  # the run's control traits
    per_ctrl = (t.crossJoin(F.broadcast(controls)).select("against", "value", "nt", F.lit(0).cast("long").alias("nc"))
                .unionByName(c.select(F.col("trait").alias("against"), "value", F.lit(0).cast("long").alias("nt"),
                                      F.col("n").alias("nc"))))
    return (per_ctrl.groupBy("against", "value").agg(F.sum("nt").alias("nt"), F.sum("nc").alias("nc"))
            .unionByName(_pooled(counts)))


def kolmogorov_sf(x: float, terms: int = 100) -> float:
    """Survival function of the Kolmogorov limit distribution."""
    if x <= 0:
        return 1.0
    s = 0.0
    for k in range(1, terms + 1):
        s += (-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x)
    return max(0.0, min(1.0, 2.0 * s))


EXACT_KS = 10_000  # the larger sample, up to which the p of D is exact
EXACT_U, EXACT_U_PAIRS = 8, 200_000  # the smaller sample, and pairs, up to which the p of U is (without ties)


def ks_exact_sf(d: float, n1: int, n2: int) -> float:
    """P(D >= d) for two samples without ties, by lattice paths.

    A merged order is a path of n1 steps right and n2 up; D < d where it never
    leaves the band ``|i n2 - j n1| < d n1 n2``.  Row by row the share of paths
    inside is carried on; a row's new shares are running sums of the last row's."""
    edge = round(d * n1 * n2)
    if edge <= 0:
        return 1.0
    j = np.arange(n2 + 1)
    inside = (np.abs(j * n1) < edge).astype(float)
    for i in range(1, n1 + 1):
        # scaled by i / (i + n2), which keeps the share of all paths at one
        inside = np.cumsum(np.where(np.abs(i * n2 - j * n1) < edge, inside * (i / (i + n2)), 0.0))
        inside[np.abs(i * n2 - j * n1) >= edge] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[-1])))


def u_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) for two samples without ties, from the number of orders with
    each U: the factors ``(1 - q^(n2+i)) / (1 - q^i)`` one after the other."""
    ways = np.array([1] + [0] * (n1 * n2), dtype=object)  # whole numbers of any size
    for i in range(1, n1 + 1):
        ways[n2 + i:] = ways[n2 + i:] - ways[:-(n2 + i)]
        for k in range(i):  # division: running sums at a distance of i
            ways[k::i] = np.cumsum(ways[k::i])
    at = max(math.ceil(u - 1e-9), 0)
    return sum(ways[at:]) / sum(ways)


@F.pandas_udf(DoubleType())
def _ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series, exact: pd.Series) -> pd.Series:
    out = []
    for dv, a, b, small_exact in zip(d, n1, n2, exact):
        if not (a and b):
            out.append(float("nan"))
        elif small_exact and max(a, b) <= EXACT_KS:
            out.append(ks_exact_sf(dv, int(a), int(b)))
        else:
            out.append(kolmogorov_sf(math.sqrt(a * b / (a + b)) * dv))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _u_p(u: pd.Series, z: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for uv, zv, a, b, t in zip(u, z, n1, n2, ties):
        if t == 0 and 0 < min(a, b) <= EXACT_U and a * b <= EXACT_U_PAIRS:
            out.append(u_exact_sf(uv, int(a), int(b)))
        else:
            out.append(0.5 * math.erfc(zv / math.sqrt(2.0)) if zv is not None and zv == zv else float("nan"))
    return pd.Series(out, dtype="float64")


def ks_two_sample(wr: DataFrame, with_p: bool = True, exact: bool = True) -> DataFrame:
    """ST9: ``(against, n1, n2, d[, p])``, D = max |F_target - F_other| over
    the merged distinct values.  p is exact for samples of up to ``EXACT_KS``
    (``exact``), else from the limit distribution (one tiny Arrow batch)."""
    g = _comparisons(wr)
    cum = distributed_cumsum(g, [F.col("value").asc()], ["nt", "nc"], ["against"])
    tot = cum.groupBy("against").agg(F.max("nt_cum").alias("n1"), F.max("nc_cum").alias("n2"))
    j = cum.join(F.broadcast(tot), "against")
    diff = F.abs(F.col("nt_cum") / F.col("n1") - F.col("nc_cum") / F.col("n2"))
    out = j.groupBy("against", "n1", "n2").agg(F.max(diff).alias("d"))
    if with_p:
        out = out.withColumn("p", _ks_p(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double"), F.lit(exact)))
    return out


def mann_whitney(wr: DataFrame, with_p: bool = True) -> DataFrame:
    """ST10: target vs pooled controls, alternative 'greater'.

    Average ranks per distinct value (WN7): ``before + (count + 1) / 2``;
    ``U1 = R1 - n1 (n1 + 1) / 2``; normal approximation with tie and continuity
    correction.  p is exact where the smaller sample has up to ``EXACT_U`` values
    and none are tied, else that of z.  Returns ``(n1, n2, u1, u2, z[, p])``."""
    g = _pooled(_value_counts(wr)).drop("against").withColumn("cnt", F.col("nt") + F.col("nc"))
    cum = distributed_cumsum(g, [F.col("value").asc()], ["cnt"])

    def exact(x):  # whole numbers beyond 2^53 stay exact
        return F.sum(x.cast("decimal(38,0)"))
    cnt = F.col("cnt").cast("decimal(19,0)")
    twice = F.col("nt").cast("decimal(18,0)") * ((F.col("cnt_cum") - F.col("cnt")) * 2 + F.col("cnt") + 1).cast("decimal(19,0)")
    sums = cum.agg(exact(twice).alias("r1x2"), F.sum("nt").alias("n1"), F.sum("nc").alias("n2"),
                   F.sum(F.pow(F.col("cnt").cast("double"), 3) - cnt.cast("double")).alias("ties"))
    n1x = F.col("n1").cast("decimal(18,0)") * (F.col("n1") + 1).cast("decimal(19,0)")
    agg = sums.select(((F.col("r1x2") - n1x.cast("decimal(38,0)")).cast("double") / 2.0).alias("u"),
                      F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), "ties")
    n = F.col("n1") + F.col("n2")
    u1 = F.col("u")
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0
                   * ((n + 1.0) - F.col("ties") / (n * (n - 1.0))))
    out = agg.select(
        F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
        u1.alias("u1"), (F.col("n1") * F.col("n2") - u1).alias("u2"),
        F.try_divide(u1 - F.col("n1") * F.col("n2") / 2.0 - 0.5, sigma).alias("z"), "ties")
    if with_p:
        out = out.withColumn("p", _u_p("u1", "z", F.col("n1").cast("double"), F.col("n2").cast("double"), "ties"))
    return out.drop("ties")


def tail_report(wr: DataFrame) -> DataFrame:
    """ST12: tail means at 1/5/10/20 % with the always-inf degenerate rule."""
    from prefscan.operators.detection import TAIL_GAMMAS, z_top_gamma
    return z_top_gamma(wr, (), TAIL_GAMMAS, tail_rule=True)


__all__ = ["trait_histogram", "trait_ccdf", "median_shift", "ks_two_sample", "mann_whitney",
           "tail_report", "pooled_series"]
