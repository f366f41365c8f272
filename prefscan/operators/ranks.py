"""Global order without a single-task window (WN1, WN2, WN4-WN7, A8, A9).

A window without ``partitionBy`` pulls every row into one task.  Instead:

1. ``orderBy`` range-partitions and sorts (a distributed sort with spill);
2. each row records its partition id and its index inside the partition
   (``monotonically_increasing_id`` minus the partition base);
3. the result is checkpointed to the shared folder so every later job sees
   the same partitions even when stages are re-run;
4. per-partition counts (one row per partition and group, a size bounded by
   the partition count) give exclusive prefix offsets, which are broadcast
   back.

Rank = offset + index inside the partition + 1.  Groups (e.g. traits) may span
partitions and a single hot group is split over many tasks like any other
range of the sort order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefscan.session import materialize, small

_PID = "_rk_pid"
_LOCAL = "_rk_local"


def _offsets(df: DataFrame, stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """``df`` joined to its per-(partition, group) offsets.  The table, about one
    row per partition and group, is written once, so counting it and joining
    it do not both aggregate the sorted data.  Null groups match themselves."""
    stats = materialize(stats)
    stats = small(stats.select(F.col(_PID).alias("_o_pid"), *[F.col(g).alias(f"_o_{g}") for g in group],
                               *[c for c in stats.columns if c not in (_PID, *group)]), 256)
    on = df[_PID] == stats["_o_pid"]
    for g in group:
        on = on & df[g].eqNullSafe(stats[f"_o_{g}"])
    return df.join(stats, on).drop("_o_pid", *[f"_o_{g}" for g in group])


def _sorted_with_positions(df: DataFrame, order: Sequence[Column],
                           group: Sequence[str]) -> DataFrame:
    keys = [F.col(g).asc() for g in group] + list(order)
    s = (df.orderBy(*keys)
         .withColumn(_PID, F.spark_partition_id())
         .withColumn(_LOCAL, F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    return materialize(s)


def distributed_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                     group: Sequence[str] = ()) -> DataFrame:
    """1-based ``row_number`` over ``order`` (within ``group``) with no
    single-task window.  ``order`` must be a total order for reproducible
    ranks (add a unique id as the last key)."""
    group = list(group)
    s = _sorted_with_positions(df, order, group)
    stats = s.groupBy(_PID, *group).agg(
        F.count(F.lit(1)).alias("_rk_n"), F.min(_LOCAL).alias("_rk_first"))
    w = Window.partitionBy(*group).orderBy(_PID) if group else Window.orderBy(_PID)
    stats = stats.withColumn(
        "_rk_off", F.coalesce(F.sum("_rk_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    joined = _offsets(s, stats, group)
    return joined.withColumn(
        rank_col, (F.col("_rk_off") + F.col(_LOCAL) - F.col("_rk_first") + 1).cast("long")
    ).drop(_PID, _LOCAL, "_rk_n", "_rk_first", "_rk_off")


def _running_in_partition(sums: Sequence[str], group: Sequence[str]):
    """Per-partition running sums over rows that arrive sorted by
    ``(group, order)`` (the checkpointed range partitions).  Only the first
    group of a batch can continue the previous batch's last group, so one
    carried row links consecutive Arrow batches.  No shuffle: each task reads
    its own partition once."""
    group = list(group)
    sums = list(sums)

    def run(batches):
        carry_key = None
        carry = None
        for b in batches:
            if b.empty:
                continue
            b = b.reset_index(drop=True)
            vals = b[sums].fillna(0).astype("int64")  # a sum skips nulls
            if group:
                keys = b[group].astype(object).where(b[group].notna(), None)
                local = vals.groupby([b[g] for g in group], sort=False, dropna=False).cumsum()
                first = tuple(keys.iloc[0])
                if carry is not None and first == carry_key:
                    same = pd.Series([tuple(k) == first for k in keys.itertuples(index=False)], index=b.index)
                    local.loc[same] = local.loc[same] + carry
                carry_key = tuple(keys.iloc[-1])
            else:
                local = vals.cumsum()
                if carry is not None:
                    local = local + carry
            carry = local.iloc[-1].to_numpy()
            out = b.copy()
            for c in sums:
                out[f"_cs_l_{c}"] = local[c].to_numpy()
            yield out
    return run


def distributed_cumsum(df: DataFrame, order: Sequence[Column], sums: Sequence[str],
                       group: Sequence[str] = (), suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of integer columns ``sums`` along ``order``
    (within ``group``).

    After the range-partitioned sort and the checkpoint, each partition holds
    one contiguous, sorted range; its running sums are computed where it lies
    (Arrow batches, no second shuffle) and the per-partition totals (a table
    bounded by partitions and groups) give each partition's offset.
    """
    group = list(group)
    s = _sorted_with_positions(df, order, group)
    tot = s.groupBy(_PID, *group).agg(*[F.sum(c).alias(f"_cs_t_{c}") for c in sums])
    w = Window.partitionBy(*group).orderBy(_PID) if group else Window.orderBy(_PID)
    for c in sums:
        tot = tot.withColumn(
            f"_cs_o_{c}",
            F.coalesce(F.sum(f"_cs_t_{c}").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)))
    tot = tot.drop(*[f"_cs_t_{c}" for c in sums])
    schema = StructType(s.schema.fields + [StructField(f"_cs_l_{c}", LongType()) for c in sums])
    out = _offsets(s.mapInPandas(_running_in_partition(sums, group), schema), tot, group)
    for c in sums:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_cs_l_{c}") + F.col(f"_cs_o_{c}"))
    return out.drop(_PID, _LOCAL, *[f"_cs_l_{c}" for c in sums], *[f"_cs_o_{c}" for c in sums])


BUCKETS = 4096


def order_statistics(df: DataFrame, value: str, want: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Exact order statistics without sorting all rows.

    ``want``: ``(*group, p)`` with 1-based ascending positions, a small table.
    Returns ``(*group, p, value, upper_sum)``: the value at the position and
    the sum of that value and everything above it.  Null values do not count;
    NaN is above all numbers.

    Two passes: the rows of each group are counted and summed in ``BUCKETS``
    ranges of equal width (merged before the shuffle, so a hot group costs no
    more than its ranges), then only the ranges that hold a wanted position
    are ranked."""
    group = list(group)
    base = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))), F.col("_v"))
    edges = materialize(base.groupBy(*group).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    edges = small(edges.select(*[F.col(g).alias(f"_e_{g}") for g in group], "_lo", "_hi"), 128)
    at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(BUCKETS)))
    bucket = (F.when(F.isnan("_v") | (F.col("_v") > F.col("_hi")), F.lit(BUCKETS))
              .when(F.col("_lo").isNull(), F.when(F.col("_v") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1)))
              .when(F.col("_v") < F.col("_lo"), F.lit(-1))
              .when(F.col("_lo") == F.col("_hi"), F.lit(0))
              .otherwise(F.least(at, F.lit(BUCKETS - 1)))).cast("int")
    cut = base.join(edges, _same(base, edges, group, "_e_")) if group else base.crossJoin(F.broadcast(edges))
    cut = cut.select(*group, "_v", bucket.alias("_b"))
    counts = materialize(cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s")))
    # at most BUCKETS + 2 rows per group
    up = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*group).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(*group, "_b", "_n", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_below"),
                           F.coalesce(F.sum("_s").over(down), F.lit(0.0)).alias("_over"))
    want = want.select(*[F.col(g).alias(f"_w_{g}") for g in group], "p").distinct()
    hit = places.join(F.broadcast(want), _same(places, want, group, "_w_")) if group else places.crossJoin(F.broadcast(want))
    hit = materialize(hit.where((F.col("p") > F.col("_below")) & (F.col("p") <= F.col("_below") + F.col("_n")))
                      .select(*group, "_b", "p", "_below", "_over"))
    keys = hit.select(*[F.col(g).alias(f"_k_{g}") for g in group], F.col("_b").alias("_k__b")).distinct()
    inside = cut.join(small(keys, 128), _same(cut, keys, [*group, "_b"], "_k_"), "left_semi")
    ranked = distributed_rank(inside, [F.col("_v").asc()], "_r", [*group, "_b"])
    found = hit.select(*[F.col(g).alias(f"_h_{g}") for g in group], F.col("_b").alias("_h__b"), "p", "_below", "_over")
    rows = ranked.join(small(found, 128), _same(ranked, found, [*group, "_b"], "_h_"))
    rows = rows.where(F.col("_r") >= F.col("p") - F.col("_below"))
    return rows.groupBy(*group, "p").agg(
        F.min_by("_v", "_r").alias("value"), (F.sum("_v") + F.first("_over")).alias("upper_sum"))


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str], prefix: str) -> Column:
    """Equal columns, null equal to null; ``right``'s carry a prefix."""
    out = F.lit(True)
    for c in cols:
        out = out & left[c].eqNullSafe(right[prefix + c])
    return out


def exact_percentiles(df: DataFrame, value: str, ps: Sequence[float],
                      group: Sequence[str] = (), out: str = "value") -> DataFrame:
    """Linear-interpolated percentiles (numpy default, DuckDB
    ``quantile_cont``) per group, exact, without sorting or collecting a group.

    Returns ``(*group, p, <out>)``.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_pn"))
    pdf = df.sparkSession.createDataFrame([(float(p),) for p in ps], "q double")
    need = materialize(counts.where("_pn > 0").crossJoin(F.broadcast(pdf))
                       .withColumn("_ph", (F.col("_pn") - 1).cast("double") * F.col("q"))
                       .withColumn("_plo", F.floor("_ph").cast("long") + 1)
                       .withColumn("_phi", F.least(F.col("_plo") + 1, F.col("_pn"))))
    want = need.select(*group, F.explode(F.array("_plo", "_phi")).alias("p"))
    got = order_statistics(df, value, want, group).select(*[F.col(g).alias(f"_g_{g}") for g in group],
                                                          F.col("p").alias("_g_p"), "value")
    # groups x percentiles x 2 rows
    hits = need.join(got, _same(need, got, group, "_g_") & F.col("_g_p").isin(F.col("_plo"), F.col("_phi")))
    res = hits.groupBy(*group, "q", "_ph", "_plo").agg(
        F.max(F.when(F.col("_g_p") == F.col("_plo"), F.col("value"))).alias("_vlo"),
        F.max(F.when(F.col("_g_p") == F.col("_phi"), F.col("value"))).alias("_vhi"))
    frac = F.col("_ph") - (F.col("_plo") - 1).cast("double")
    return res.select(*group, F.col("q").alias("p"), (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias(out))


def top_k_mean(df: DataFrame, value: str, k: Column | str, group: Sequence[str]) -> DataFrame:
    """A5: mean of the ``k`` largest values per group (``k`` a column of the
    frame, constant per group; at most the group's rows).  ``(*group, topk_mean)``."""
    group = list(group)
    kcol = F.col(k) if isinstance(k, str) else k
    want = materialize(df.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.max(kcol).alias("_k")).select(
        *group, F.least("_n", "_k").alias("_k"), (F.col("_n") - F.least("_n", "_k") + 1).alias("p")))
    got = order_statistics(df, value, want, group).select(*[F.col(g).alias(f"_g_{g}") for g in group], "upper_sum")
    return want.join(got, _same(want, got, group, "_g_")).select(*group, (F.col("upper_sum") / F.col("_k")).alias("topk_mean"))
