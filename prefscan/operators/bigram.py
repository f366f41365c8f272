"""WN10: a bigram scorer with causal context.

Token ``t`` is scored given the token before it; the first response token is
scored given the last prompt token, and when the prompt is empty the first
response token is not scored at all (it has no context).

    p_bi(t | u)  = m c(u, t) / c(u) + (1 - m) p_uni(t)      (p_uni(t) when c(u) = 0)
    p(t | u, k)  = (1 - l) p_bi(t | u) + l p_k(t)

with ``c(u, t)`` the background bigram counts, ``c(u)`` the number of times
``u`` precedes a token, ``p_uni`` and ``p_k`` the smoothed unigram models of
``prefscan.operators.ngram``.  Bigrams are formed inside each row from the
token array (no window over a document, however long), equal bigrams of a text
are looked up once, and every lookup uses the size-checked head/tail join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscan.operators.ngram import LP_SCALE, head_cut, lookup_join
from prefscan.session import materialize


def bigrams(toks: str) -> F.Column:
    """``array<struct<prev, token>>`` of consecutive tokens."""
    n = F.size(toks)
    return F.when(n > 1, F.arrays_zip(F.slice(toks, 1, n - 1).alias("prev"),
                                      F.slice(toks, 2, n - 1).alias("token"))
                  ).otherwise(F.array().cast("array<struct<prev:string,token:string>>"))


@dataclass
class BigramModel:
    uni: DataFrame        # token, c_bg, p_uni, p_0 .. p_{K-1}
    bi: DataFrame         # prev, token, c2
    pred: DataFrame       # prev, c1
    uni_cut: int          # weights from which rows are broadcast (see ``head_cut``)
    bi_cut: int
    pred_cut: int
    conditions: list[str]
    oov: dict[str, float]
    mu: float
    lam: float


def fit_bigram(background: DataFrame, cond_tokens: DataFrame, conditions: Sequence[str],
               alpha: float = 1.0, lam: float = 0.5, mu: float = 0.5,
               tokens_col: str = "tokens") -> BigramModel:
    conditions = list(conditions)
    uni_c = (background.select(F.explode(tokens_col).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("c_bg")))
    cc = (cond_tokens.where(F.col("condition").isin(conditions))
          .select("condition", F.explode(tokens_col).alias("token"))
          .groupBy("token").agg(*[F.count(F.when(F.col("condition") == c, 1)).alias(f"c_{i}")
                                  for i, c in enumerate(conditions)]))
    counts = uni_c.join(cc, "token", "full_outer").select(
        "token", F.coalesce("c_bg", F.lit(0)).cast("long").alias("c_bg"),
        *[F.coalesce(f"c_{i}", F.lit(0)).cast("long").alias(f"c_{i}") for i in range(len(conditions))])
    counts = materialize(counts)
    meta = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum("c_bg").alias("n_bg"),
                      F.count(F.when(F.col("c_bg") > 0, 1)).alias("v"),
                      *[F.sum(f"c_{i}").alias(f"n_{i}") for i in range(len(conditions))]).first()
    v = int(meta["v"])
    d_bg = float(meta["n_bg"] or 0) + alpha * (v + 1)
    d_k = [float(meta[f"n_{i}"] or 0) + alpha * (v + 1) for i in range(len(conditions))]
    uni = counts.select("token", "c_bg", ((F.col("c_bg") + alpha) / F.lit(d_bg)).alias("p_uni"),
                        *[((F.col(f"c_{i}") + alpha) / F.lit(d_k[i])).alias(f"p_{i}")
                          for i in range(len(conditions))])
    oov = {"p_uni": alpha / d_bg, **{f"p_{i}": alpha / d_k[i] for i in range(len(conditions))}}
    bi = materialize(background.select(F.inline(bigrams(tokens_col)))
                     .groupBy("prev", "token").agg(F.count(F.lit(1)).alias("c2")))
    pred = materialize(bi.groupBy("prev").agg(F.sum("c2").alias("c1")))
    return BigramModel(uni, bi, pred, head_cut(counts, "c_bg", ["token"], 8 * len(uni.columns)),
                       head_cut(bi, "c2", ["prev", "token"], 8), head_cut(pred, "c1", ["prev"], 8),
                       conditions, oov, mu, lam)


def score_bigram(df: DataFrame, keys: Sequence[str], prompt_tokens: str, resp_tokens: str,
                 model: BigramModel) -> DataFrame:
    """Per row: ``n_scored`` and ``lp_base_mean``, ``lp_<i>_mean`` over the
    scored response tokens (0.0 when nothing is scored)."""
    keys = list(keys)
    prev_first = F.try_element_at(prompt_tokens, F.lit(-1))
    n = F.size(resp_tokens)
    prevs = F.concat(F.array(prev_first), F.slice(resp_tokens, 1, F.greatest(n - 1, F.lit(0))))
    pairs = df.select(*keys, F.explode_outer(F.arrays_zip(prevs.alias("prev"),
                                                          F.col(resp_tokens).alias("token"))).alias("_p"))
    rows = pairs.select(*keys, F.col("_p.prev").alias("prev"), F.col("_p.token").alias("token"))
    scored = rows.where(F.col("prev").isNotNull() & F.col("token").isNotNull())
    # equal bigrams of a text travel once, with their number
    scored = scored.groupBy(*keys, "prev", "token").agg(F.count(F.lit(1)).alias("_n"))
    j = lookup_join(scored, model.uni, ["token"], "c_bg", model.uni_cut, keys)
    j = lookup_join(j, model.pred, ["prev"], "c1", model.pred_cut, keys)
    j = lookup_join(j, model.bi, ["prev", "token"], "c2", model.bi_cut, keys)
    p_uni = F.coalesce("p_uni", F.lit(model.oov["p_uni"]))
    c1 = F.coalesce("c1", F.lit(0)).cast("double")
    c2 = F.coalesce("c2", F.lit(0)).cast("double")
    p_bi = F.when(c1 > 0, F.lit(model.mu) * c2 / c1 + F.lit(1.0 - model.mu) * p_uni).otherwise(p_uni)

    def units(p: F.Column) -> F.Column:
        return F.sum(F.col("_n") * F.round(F.ln(p) * F.lit(float(LP_SCALE))).cast("long")) / F.lit(float(LP_SCALE))

    aggs = [F.sum("_n").alias("n_scored"), units(p_bi).alias("lp_base_sum")]
    for i in range(len(model.conditions)):
        p_k = F.coalesce(F.col(f"p_{i}"), F.lit(model.oov[f"p_{i}"]))
        aggs.append(units(F.lit(1.0 - model.lam) * p_bi + F.lit(model.lam) * p_k).alias(f"lp_{i}_sum"))
    per = j.groupBy(*keys).agg(*aggs)
    out = df.select(*keys).join(per, keys, "left")
    denom = F.greatest(F.coalesce("n_scored", F.lit(0)), F.lit(1)).cast("double")
    cols = ["lp_base"] + [f"lp_{i}" for i in range(len(model.conditions))]
    return out.select(*keys, F.coalesce("n_scored", F.lit(0)).cast("long").alias("n_scored"),
                      *[(F.coalesce(f"{c}_sum", F.lit(0.0)) / denom).alias(f"{c}_mean") for c in cols])
