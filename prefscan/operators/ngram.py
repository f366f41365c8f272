"""SC2 / A15: a relational language model used as the scorer.

The neural scorer of the reference is replaced by an interpolated unigram
model built from joins and aggregates (Jelinek-Mercer interpolation of a
background model with one model per condition, add-alpha smoothing, an
explicit out-of-vocabulary bucket):

    p_bg(t)      = (c_bg(t) + a) / (N_bg + a (V + 1))
    p_k(t)       = (c_k(t)  + a) / (N_k  + a (V + 1))
    p(t | k)     = (1 - l) p_bg(t) + l p_k(t)

``V`` is the background vocabulary size, ``N`` the token totals.  A response
scores ``mean ln p`` over its tokens (divisor ``max(n, 1)``; an empty response
scores 0.0), under the baseline (``p_bg``) and under every condition ``k``.

Log-probabilities are kept as whole numbers of ``1 / LP_SCALE``, so sums over
tokens are exact: they do not depend on the order in which tasks add them, and
equal texts get equal scores on every run.

Scale plan
----------
* The model is *wide*: one row per token with ``lp_base, lp_0 .. lp_{K-1}``,
  so response tokens join it once, not once per condition.
* The counts are checkpointed to the shared folder (reused, and their size in
  bytes is known before the join strategy is chosen).
* The most frequent tokens, as many as fit the broadcast bound, are the head;
  it is broadcast.  A small vocabulary is all head.  What is left, the tail,
  holds no hot token; the text's tokens outside the head are reduced to term
  frequencies per text and only these are shuffle-joined, in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.session import broadcast_bytes, materialize

LP_SCALE = 10 ** 10


def token_counts(df: DataFrame, tokens_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """``explode(tokens).groupBy(keys, token).count()`` (map-side partial
    aggregation keeps hot tokens cheap)."""
    return (df.select(*keys, F.explode(tokens_col).alias("token"))
            .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("cnt")))


@dataclass
class NgramModel:
    """A fitted wide model.  ``lm`` columns: token, c_bg, lp_base, lp_0...
    (whole numbers of ``1 / LP_SCALE``); ``cut``: tokens that often or more are
    the broadcast head (0: all)."""
    lm: DataFrame
    conditions: list[str]
    alpha: float
    lam: float
    rows: int
    cut: int = 0
    oov: dict[str, int] = field(default_factory=dict)

    def lp_cols(self) -> list[str]:
        return ["lp_base"] + [f"lp_{i}" for i in range(len(self.conditions))]


def fit_ngram(background_tokens: DataFrame, cond_tokens: DataFrame,
              conditions: Sequence[str], alpha: float = 1.0, lam: float = 0.5,
              tokens_col: str = "tokens", lams: Sequence[float] | None = None) -> NgramModel:
    """Fit the wide model.

    ``background_tokens``: rows with an ``array<string>`` column ``tokens_col``, or
    the ``token_counts`` of such rows, which several models can share.
    ``cond_tokens``: rows ``(condition, tokens_col)``; ``conditions`` lists the
    condition keys in output order (column ``lp_i`` belongs to ``conditions[i]``).
    ``lams``: several interpolation weights at once (a grid of scorer
    variants); column ``lp_{j*K+i}`` then belongs to ``lams[j]`` and
    ``conditions[i]``, so every variant is scored in the same token pass.
    """
    conditions = list(conditions)
    bg = background_tokens if background_tokens.columns == ["token", "cnt"] else token_counts(background_tokens, tokens_col)
    bg = bg.withColumnRenamed("cnt", "c_bg")
    cc = token_counts(cond_tokens.where(F.col("condition").isin(conditions)),
                      tokens_col, ["condition"])
    # columns by position: condition texts may differ only in case
    wide = cc.groupBy("token").agg(*[
        F.sum(F.when(F.col("condition") == F.lit(c), F.col("cnt"))).alias(f"c_{i}")
        for i, c in enumerate(conditions)])
    counts = bg.join(wide, "token", "full_outer")
    counts = counts.select(
        "token", F.coalesce("c_bg", F.lit(0)).cast("long").alias("c_bg"),
        *[F.coalesce(f"c_{i}", F.lit(0)).cast("long").alias(f"c_{i}")
          for i in range(len(conditions))])
    return _finish(materialize(counts), conditions, alpha, lam, lams)


def fit_corpus_ngram(docs: DataFrame, key: str, conditions: Sequence[str], alpha: float = 1.0,
                     lam: float = 0.5, tokens_col: str = "tokens",
                     lams: Sequence[float] | None = None) -> NgramModel:
    """Fit the model when the background is ``docs`` itself and condition
    ``i`` is the documents whose ``key`` equals ``conditions[i]``: one
    explode and one aggregation give every count (map-side partial
    aggregation first, so a hot token costs one row per task)."""
    conditions = list(conditions)
    tok = docs.select(F.col(key).alias("_key"), F.explode(tokens_col).alias("token"))
    counts = tok.groupBy("token").agg(
        F.count(F.lit(1)).alias("c_bg"),
        *[F.count(F.when(F.col("_key") == F.lit(c), 1)).alias(f"c_{i}") for i, c in enumerate(conditions)])
    return _finish(materialize(counts), conditions, alpha, lam, lams)


def _finish(counts: DataFrame, conditions: list[str], alpha: float, lam: float,
            lams: Sequence[float] | None) -> NgramModel:
    """Smoothed log-probabilities from materialised counts."""

    meta = counts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("c_bg").alias("n_bg"),
        F.count(F.when(F.col("c_bg") > 0, 1)).alias("v"),
        *[F.sum(f"c_{i}").alias(f"n_{i}") for i in range(len(conditions))],
    ).first()
    v = int(meta["v"])
    d_bg = float(meta["n_bg"] or 0) + alpha * (v + 1)
    d_k = [float(meta[f"n_{i}"] or 0) + alpha * (v + 1) for i in range(len(conditions))]

    def units(p: Column) -> Column:
        return F.round(F.ln(p) * F.lit(float(LP_SCALE))).cast("long")

    p_bg = (F.col("c_bg") + F.lit(alpha)) / F.lit(d_bg)
    cols = [F.col("token"), F.col("c_bg"), units(p_bg).alias("lp_base")]
    oov = {"lp_base": round(math.log(alpha / d_bg) * LP_SCALE)}
    variants = list(lams) if lams else [lam]
    k = len(conditions)
    for j, lv in enumerate(variants):
        for i in range(k):
            p_k = (F.col(f"c_{i}") + F.lit(alpha)) / F.lit(d_k[i])
            cols.append(units(F.lit(1.0 - lv) * p_bg + F.lit(lv) * p_k).alias(f"lp_{j * k + i}"))
            oov[f"lp_{j * k + i}"] = round(math.log((1.0 - lv) * alpha / d_bg + lv * alpha / d_k[i]) * LP_SCALE)
    lm = counts.select(*cols)
    return NgramModel(lm=lm, conditions=[c for _ in variants for c in conditions], alpha=alpha, lam=variants[0],
                      rows=int(meta["rows"]), cut=head_cut(counts, "c_bg", ["token"], 8 * len(cols)), oov=oov)


def head_cut(table: DataFrame, weight_col: str, keys: Sequence[str], value_bytes: int,
             bound: int | None = None) -> int:
    """The least weight whose rows still fit the broadcast bound (0: all do).

    Sizes are summed per power of two of the weight, at most 64 rows; nothing
    is sorted.  A row counts its key bytes, ``value_bytes`` and 40 for the
    hash table."""
    bound = broadcast_bytes(table.sparkSession) if bound is None else bound
    size = sum((F.octet_length(F.coalesce(k, F.lit(""))) for k in keys), F.lit(value_bytes + 40))
    level = F.floor(F.log2(F.greatest(F.col(weight_col).cast("double"), F.lit(1.0)))).cast("int")
    sizes = {r["l"]: r["b"] for r in table.groupBy(level.alias("l")).agg(F.sum(size).alias("b")).collect()}
    total, cut = 0, None
    for lv in sorted(sizes, reverse=True):
        total += sizes[lv]
        if total > bound:
            return cut if cut is not None else 2 ** (lv + 1)
        cut = 2 ** lv
    return 0


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight_col: str, cut: int,
                salt: Sequence[str]) -> DataFrame:
    """Left-join ``rows`` to a lookup ``table`` (unique on ``keys``) in one pass.

    The head (weight of at least ``cut``) is broadcast.  Rows it does not serve
    go on to the tail with their key; served rows, and rows without a key, get
    a key made of ``salt`` columns that matches nothing, so they are spread
    evenly.  ``cut`` 0: all of the table is head."""
    keys = list(keys)
    values = [c for c in table.columns if c not in keys]
    head = table if not cut else table.where(F.col(weight_col) >= cut)
    out = rows.join(F.broadcast(head), keys, "left")
    if not cut:
        return out
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*salt).cast("string"))
    settled = F.col(weight_col).isNotNull() | F.col(keys[0]).isNull()
    out = out.withColumn("_tk", F.when(settled, spread).otherwise(F.col(keys[0])))
    tail = table.where(F.col(weight_col) < cut).select(
        F.col(keys[0]).alias("_tk"), *[F.col(k).alias(f"_t_{k}") for k in keys[1:]],
        *[F.col(c).alias(f"_t_{c}") for c in values])
    on = out["_tk"] == tail["_tk"]
    for k in keys[1:]:
        on = on & (out[k] == tail[f"_t_{k}"])
    joined = out.join(tail, on, "left")
    kept = [joined[c] for c in rows.columns]
    return joined.select(*kept, *[F.coalesce(out[c], tail[f"_t_{c}"]).alias(c) for c in values])


def score_tokens(df: DataFrame, keys: Sequence[str], tokens_col: str, model: NgramModel,
                 side: str | None = None, sides: Sequence[str] = (), cut: int | None = None) -> DataFrame:
    """Score every row's token array under the baseline and all conditions.

    Returns one row per ``keys`` with ``n_tokens`` and, per lp column,
    ``<lp>_sum`` and ``<lp>_mean``.  With ``side``/``sides`` the aggregation is
    pivoted in the same pass (``n_tokens_<s>``, ``<lp>_sum_<s>``,
    ``<lp>_mean_<s>``), so chosen and rejected responses of one example meet
    without a second shuffle.  ``cut`` overrides the model's head."""
    keys = list(keys)
    cut = model.cut if cut is None else cut
    extra = [side] if side else []
    lp_cols = model.lp_cols()
    head = model.lm.where(F.col("c_bg") >= cut) if cut else model.lm
    tok = df.select(*keys, *extra, F.explode_outer(tokens_col).alias("token"))
    # ``_n``: tokens a row stands for; ``_s_<lp>``: their summed log-probabilities
    rows = tok.join(F.broadcast(head), "token", "left")
    known = F.col("token").isNotNull()
    if cut:
        miss = known & F.col("lp_base").isNull()
        # one row per text for all its head tokens, one per tail token (term frequency)
        rows = rows.groupBy(*keys, *extra, F.when(miss, F.col("token")).alias("_tail")).agg(
            F.count("token").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in lp_cols])
        key = F.coalesce("_tail", F.concat(F.lit("\u0000"), F.xxhash64(*keys).cast("string")))
        tail = model.lm.where(F.col("c_bg") < cut).drop("c_bg").withColumnRenamed("token", "_tk")
        rows = rows.withColumn("_tk", key).join(tail, "_tk", "left")
        sums = {c: F.when(F.col("_tail").isNotNull(), F.col("_n") * F.coalesce(F.col(c), F.lit(model.oov[c])))
                .otherwise(F.col(f"_s_{c}")) for c in lp_cols}
        n = F.col("_n")
    else:
        sums = {c: F.when(known, F.coalesce(F.col(c), F.lit(model.oov[c]))) for c in lp_cols}
        n = known.cast("long")

    aggs = []
    for s in (sides if side else [None]):
        sfx = f"_{s}" if side else ""

        def own(x: Column, s=s) -> Column:
            return F.when(F.col(side) == F.lit(s), x) if side else x
        aggs.append(F.coalesce(F.sum(own(n)), F.lit(0)).alias(f"n_tokens{sfx}"))
        aggs += [(F.coalesce(F.sum(own(sums[c])), F.lit(0)) / F.lit(float(LP_SCALE))).alias(f"{c}_sum{sfx}")
                 for c in lp_cols]
    out = rows.groupBy(*keys).agg(*aggs)
    means = []
    for sfx in ([f"_{s}" for s in sides] if side else [""]):
        denom = F.greatest(F.col(f"n_tokens{sfx}"), F.lit(1)).cast("double")
        means += [(F.col(f"{c}_sum{sfx}") / denom).alias(f"{c}_mean{sfx}") for c in lp_cols]
    return out.select("*", *means)
