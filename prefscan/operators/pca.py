"""Standardisation, argmax assignment, covariance and principal components of
the weight matrix (ST3-ST6, ST13, A13, A16, A17, WN4, WN9).

The matrix is N x T with a small T (traits).  Everything that touches N rows
is a DataFrame aggregation or projection; only the T x T covariance (a
bounded, config-sized object) reaches the driver for the eigen step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.operators.ranks import order_statistics
from prefscan.session import materialize

TAIL_PCA_GAMMAS = (0.05, 0.10)


def _q(name: str) -> str:
    return f"`{name}`"


def standardize(wide: DataFrame, traits: Sequence[str], id_col: str = "example_id") -> DataFrame:
    """ST3 / A16: ``(w - mean) / std_pop`` per trait, std 0 -> scale 1 (as a
    standard scaler does).  One aggregate row, broadcast."""
    traits = list(traits)
    mom = wide.agg(*[F.avg(_q(t)).alias(f"_m{i}") for i, t in enumerate(traits)],
                   *[F.stddev_pop(_q(t)).alias(f"_s{i}") for i, t in enumerate(traits)])
    x = wide.crossJoin(F.broadcast(mom))
    cols = []
    for i, t in enumerate(traits):
        sd = F.col(f"_s{i}")
        scale = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        cols.append(((F.col(_q(t)) - F.col(f"_m{i}")) / scale).alias(t))
    return x.select(id_col, *cols)


def assigned_of(traits: Sequence[str]) -> Column:
    """WN9: the trait with the largest standardised weight of a row, first on
    ties (in trait order)."""
    arr = F.array(*[F.col(_q(t)) for t in traits])
    names = F.array(*[F.lit(t) for t in traits])
    return F.try_element_at(names, F.array_position(arr, F.array_max(arr)).cast("int"))


def assign_trait(z: DataFrame, traits: Sequence[str], id_col: str = "example_id") -> DataFrame:
    return z.select(id_col, assigned_of(list(traits)).alias("assigned"))


def cluster_sizes(assigned: DataFrame, traits: Sequence[str]) -> DataFrame:
    """Examples per assigned trait, zero for traits nobody chose."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(t, i) for i, t in enumerate(traits)], "assigned string, ord int")
    cnt = assigned.groupBy("assigned").agg(F.count(F.lit(1)).alias("n"))
    return names.join(cnt, "assigned", "left").select(
        "assigned", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def covariance(z: DataFrame, traits: Sequence[str]) -> DataFrame:
    """Sample covariance of every trait pair in one aggregation pass;
    ``(trait_a, trait_b, cov)`` for a <= b."""
    traits = list(traits)
    pairs = [(a, b) for i, a in enumerate(traits) for b in traits[i:]]
    row = z.agg(*[F.covar_samp(_q(a), _q(b)).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("trait_a"), F.lit(b).alias("trait_b"), F.col(f"_c{k}").alias("cov"))
               for k, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*entries)))


def _eigen(cov_rows, traits: Sequence[str], k: int = 2):
    """Driver-side eigen step on the T x T covariance (T small).  Signs are
    fixed so that the loading with the largest magnitude is positive."""
    idx = {t: i for i, t in enumerate(traits)}
    t = len(traits)
    c = np.zeros((t, t))
    for r in cov_rows:
        a, b = idx[r["trait_a"]], idx[r["trait_b"]]
        v = r["cov"] if r["cov"] is not None else 0.0
        c[a, b] = c[b, a] = v
    vals, vecs = np.linalg.eigh(c)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    return vals[:k], vecs[:, :k], ratio[:k]


def pca2(z: DataFrame, traits: Sequence[str], id_col: str = "example_id", center: bool = True):
    """ST4: first two components.  Returns ``(scores, loadings)``:
    ``scores(example_id, pc1, pc2)`` and ``loadings(trait, pc1, pc2,
    explained_1, explained_2)``.  The projection is column arithmetic on the
    (re-)centred data, so it runs where the rows are."""
    traits = list(traits)
    spark = z.sparkSession
    if center:
        mean = z.agg(*[F.avg(_q(t)).alias(f"_m{i}") for i, t in enumerate(traits)])
        zc = z.crossJoin(F.broadcast(mean)).select(
            id_col, *[(F.col(_q(t)) - F.col(f"_m{i}")).alias(t) for i, t in enumerate(traits)])
    else:
        zc = z
    cov_rows = covariance(zc, traits).collect()          # T (T + 1) / 2 rows
    _, vecs, ratio = _eigen(cov_rows, traits)
    pcs = []
    for j in range(vecs.shape[1]):
        expr = None
        for i, t in enumerate(traits):
            term = F.col(_q(t)) * F.lit(float(vecs[i, j]))
            expr = term if expr is None else expr + term
        pcs.append(expr.alias(f"pc{j + 1}"))
    scores = zc.select(id_col, *pcs)
    loadings = spark.createDataFrame(
        [(t, float(vecs[i, 0]), float(vecs[i, 1]) if vecs.shape[1] > 1 else 0.0,
          float(ratio[0]), float(ratio[1]) if len(ratio) > 1 else 0.0) for i, t in enumerate(traits)],
        "trait string, pc1 double, pc2 double, explained_1 double, explained_2 double")
    return scores, loadings


def loading_arrows(scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """ST13: arrow ends ``loading * 0.8 * max|score|`` and label positions
    at 1.1 times the arrow."""
    mx = scores.agg(F.greatest(F.max(F.abs("pc1")), F.max(F.abs("pc2"))).alias("_mx"))
    x = loadings.crossJoin(F.broadcast(mx)).withColumn("_sc", F.col("_mx") * F.lit(0.8))
    return x.select("trait", "pc1", "pc2", "explained_1", "explained_2",
                    (F.col("pc1") * F.col("_sc")).alias("arrow_x"), (F.col("pc2") * F.col("_sc")).alias("arrow_y"),
                    (F.col("pc1") * F.col("_sc") * 1.1).alias("label_x"),
                    (F.col("pc2") * F.col("_sc") * 1.1).alias("label_y"))


def tail_threshold(z: DataFrame, target: str, gammas: Sequence[float] = TAIL_PCA_GAMMAS,
                   id_col: str = "example_id") -> DataFrame:
    """WN4: per gamma the k-th largest standardised target weight
    (``k = max(int(n gamma), 1)``) and how many rows reach it (``>=``, so ties
    can exceed k).  ``(gamma, k, threshold, n_selected)``."""
    spark = z.sparkSession
    base = z.select(F.col(id_col).alias("_id"), F.col(_q(target)).alias("_v"))
    n = base.agg(F.count("_v").alias("_n"))
    g = spark.createDataFrame([(float(x),) for x in gammas], "gamma double").crossJoin(F.broadcast(n)).where("_n > 0")
    g = materialize(g.withColumn("k", F.greatest(F.floor(F.col("_n").cast("double") * F.col("gamma")), F.lit(1)))
                    .withColumn("p", F.col("_n") - F.col("k") + 1))
    thr = order_statistics(base, "_v", g.select("p")).withColumnRenamed("value", "threshold").join(F.broadcast(g), "p")
    # one row holding every gamma's threshold, then one conditional count per
    # gamma over the rows (no join on an inequality)
    wide = thr.agg(*[F.max(F.when(F.col("gamma") == F.lit(float(x)), F.struct("k", "threshold"))).alias(f"_t{i}")
                     for i, x in enumerate(gammas)])
    counts = base.crossJoin(F.broadcast(wide)).agg(
        *[F.first(f"_t{i}").alias(f"_t{i}") for i in range(len(gammas))],
        *[F.count(F.when(F.col("_v") >= F.col(f"_t{i}.threshold"), 1)).alias(f"_n{i}")
          for i in range(len(gammas))])
    entries = [F.struct(F.lit(float(x)).alias("gamma"), F.col(f"_t{i}.k").alias("k"),
                        F.col(f"_t{i}.threshold").alias("threshold"), F.col(f"_n{i}").alias("n_selected"))
               for i, x in enumerate(gammas)]
    return counts.select(F.inline(F.array(*entries))).where(F.col("k").isNotNull())


def tail_components(z: DataFrame, traits: Sequence[str], target: str, gammas: Sequence[float],
                    id_col: str) -> list[dict]:
    """The tails of all gammas in one aggregate, a flag per gamma: threshold,
    rows, means, components, explained shares and cluster sizes.  Tails below 3
    rows are left out.  What reaches the driver are a few numbers per gamma and
    pair of traits."""
    traits = list(traits)
    kept = [r for r in tail_threshold(z, target, gammas, id_col).collect() if r["n_selected"] >= 3]
    if not kept:
        return []
    pairs = [(a, b) for i, a in enumerate(traits) for b in traits[i:]]
    own = z.withColumn("_assigned", assigned_of(traits))
    aggs = []
    for g, r in enumerate(kept):
        def held(x: Column, r=r) -> Column:
            return F.when(F.col(_q(target)) >= F.lit(r["threshold"]), x)
        aggs += [F.avg(held(F.col(_q(t)))).alias(f"_m{g}_{i}") for i, t in enumerate(traits)]
        aggs += [F.covar_samp(held(F.col(_q(a))), held(F.col(_q(b)))).alias(f"_c{g}_{k}") for k, (a, b) in enumerate(pairs)]
        aggs += [F.count(held(F.when(F.col("_assigned") == F.lit(t), 1))).alias(f"_n{g}_{i}") for i, t in enumerate(traits)]
    row = own.agg(*aggs).first()
    out = []
    for g, r in enumerate(kept):
        _, vecs, ratio = _eigen([{"trait_a": a, "trait_b": b, "cov": row[f"_c{g}_{k}"]} for k, (a, b) in enumerate(pairs)], traits)
        out.append({"gamma": float(r["gamma"]), "threshold": r["threshold"], "n_rows": int(r["n_selected"]), "vecs": vecs,
                    "explained": [float(x) for x in [*ratio, 0.0][:2]], "means": [row[f"_m{g}_{i}"] for i in range(len(traits))],
                    "sizes": {t: row[f"_n{g}_{i}"] for i, t in enumerate(traits)}})
    return out


def tail_pca(z: DataFrame, traits: Sequence[str], target: str,
             gammas: Sequence[float] = TAIL_PCA_GAMMAS, id_col: str = "example_id") -> DataFrame:
    """ST6: for each gamma, PCA of only the rows whose standardised target
    weight reaches the k-th largest, re-centred; skipped below 3 rows.
    ``(gamma, n_rows, explained_1, explained_2, assigned, n)``."""
    rows = [(t["gamma"], t["n_rows"], *t["explained"], name, n)
            for t in tail_components(materialize(z), traits, target, gammas, id_col) for name, n in t["sizes"].items()]
    return z.sparkSession.createDataFrame(
        rows, "gamma double, n_rows bigint, explained_1 double, explained_2 double, assigned string, n bigint")


def tail_projection(z: DataFrame, traits: Sequence[str], target: str, gammas: Sequence[float] = TAIL_PCA_GAMMAS,
                    id_col: str = "example_id") -> DataFrame:
    """ST6: the rows of each tail on the tail's own two components:
    ``(gamma, id, assigned, pc1, pc2)``; tails below 3 rows are skipped.  One
    projection: a row gives an entry per tail that it is in, without a join."""
    z = materialize(z)
    traits = list(traits)
    kind = "struct<gamma: double, pc1: double, pc2: double>"
    entries = []
    for t in tail_components(z, traits, target, gammas, id_col):
        pcs = [sum((F.col(_q(name)) - F.lit(t["means"][i])) * F.lit(float(t["vecs"][i, j])) for i, name in enumerate(traits))
               if j < t["vecs"].shape[1] else F.lit(0.0) for j in range(2)]
        entries.append(F.when(F.col(_q(target)) >= F.lit(t["threshold"]), F.struct(
            F.lit(t["gamma"]).alias("gamma"), pcs[0].alias("pc1"), pcs[1].alias("pc2"))))
    found = F.filter(F.array(*entries), lambda x: x.isNotNull()) if entries else F.array().cast(f"array<{kind}>")
    rows = z.select(id_col, assigned_of(traits).alias("assigned"), F.explode(found).alias("_t"))
    return rows.select("_t.gamma", id_col, "assigned", "_t.pc1", "_t.pc2")


def flag_tail(z: DataFrame, scores: DataFrame, target: str, gamma: float, id_col: str = "example_id") -> DataFrame:
    """ST6: ``scores`` (the full projection) with ``in_tail``."""
    t = tail_threshold(z, target, [gamma], id_col).select("threshold")
    flags = z.crossJoin(F.broadcast(t)).select(id_col, (F.col(_q(target)) >= F.col("threshold")).alias("in_tail"))
    return scores.join(flags, id_col)
