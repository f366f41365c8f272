"""SQL building blocks of the DuckDB oracle.

Each helper returns text for a ``WITH`` clause; the full statements are put
together in ``prefscan.plans.oracle``.  The rules mirror the Spark code but are
written independently, as plain SQL over the registered tables.
"""

from __future__ import annotations

TOK = r"'[\p{L}\p{N}]+'"
TOK_END = r"'[\p{L}\p{N}]+|[.!?]'"


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {TOK})"


#: code points of Python's white space
SPACES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: log-probabilities are whole numbers of this fraction
UNITS = "CAST(1e10 AS DOUBLE)"


def strip(expr: str) -> str:
    return f"trim({expr}, {' || '.join(f'chr({c})' for c in SPACES)})"


def units(expr: str) -> str:
    return f"CAST(round(ln({expr}) * {UNITS}) AS BIGINT)"


def sanitize(expr: str) -> str:
    inner = f"regexp_replace(replace({expr}, ' ', '_'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g')"
    return f"regexp_replace(substring({inner}, 1, 100), '[._]+$', '')"


def contains_any(expr: str, words) -> str:
    if not words:
        return "false"
    parts = [f"contains(lower({expr}), '{w.lower()}')" for w in words]
    return "(" + " OR ".join(parts) + ")"


def ex_cte() -> str:
    return """
ex AS (
  SELECT u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS example_id, u.conv_id, u.turn,
         u.text AS prompt, a.text AS completion
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
ex_rn AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM ex),
pref AS (
  SELECT a.example_id, a.prompt, a.completion AS chosen, b.completion AS rejected
  FROM ex_rn a JOIN ex_rn b ON b.rn = a.rn + 1)"""


def sft_cte() -> str:
    return f"""
doc_tok AS (SELECT doc_id, lang, source, {toks('text')} AS tokens FROM documents),
sft AS (
  SELECT doc_id AS example_id, lang, source,
         concat_ws(' ', lang, source) AS prompt, tokens AS resp_tokens
  FROM doc_tok)"""


def lm_ctes(bg_tokens_sql: str, cond_tokens_sql: str, conditions: list[str],
            alpha: float = 1.0, lam: float = 0.5, prefix: str = "m", lams=None) -> str:
    """Wide interpolated unigram model ``{prefix}_lm(token, lp_base, lp_0..)``
    and one-row ``{prefix}_oov``.

    ``bg_tokens_sql`` yields rows ``(token)``; ``cond_tokens_sql`` yields
    ``(condition, token)``.
    """
    a = f"CAST({alpha} AS DOUBLE)"
    cc_cols = ",\n    ".join(
        f"sum(CASE WHEN condition = '{c}' THEN 1 ELSE 0 END) AS c_{i}"
        for i, c in enumerate(conditions))
    cond_list = ", ".join(f"'{c}'" for c in conditions)
    cnt_cols = ", ".join(f"coalesce(cc.c_{i}, 0) AS c_{i}" for i in range(len(conditions)))
    meta_cols = ", ".join(f"sum(c_{i}) AS n_{i}" for i in range(len(conditions)))
    d_bg = f"(n_bg + {a} * (v + 1))"
    k = len(conditions)
    variants = list(lams) if lams else [lam]
    lp_cols = ",\n    ".join(
        units(f"CAST({1.0 - lv} AS DOUBLE) * (c_bg + {a}) / {d_bg} + CAST({lv} AS DOUBLE) * (c_{i} + {a}) "
              f"/ (n_{i} + {a} * (v + 1))") + f" AS lp_{j * k + i}"
        for j, lv in enumerate(variants) for i in range(k))
    oov_cols = ",\n    ".join(
        units(f"CAST({1.0 - lv} AS DOUBLE) * {a} / {d_bg} + CAST({lv} AS DOUBLE) * {a} / (n_{i} + {a} * (v + 1))")
        + f" AS lp_{j * k + i}"
        for j, lv in enumerate(variants) for i in range(k))
    p = prefix
    return f"""
{p}_bgt AS ({bg_tokens_sql}),
{p}_bg AS (SELECT token, count(*) AS c_bg FROM {p}_bgt GROUP BY token),
{p}_cct AS ({cond_tokens_sql}),
{p}_cc AS (SELECT token,
    {cc_cols}
  FROM {p}_cct WHERE condition IN ({cond_list}) GROUP BY token),
{p}_cnt AS (
  SELECT coalesce(bg.token, cc.token) AS token, coalesce(bg.c_bg, 0) AS c_bg, {cnt_cols}
  FROM {p}_bg bg FULL OUTER JOIN {p}_cc cc ON bg.token = cc.token),
{p}_meta AS (SELECT sum(c_bg) AS n_bg, count(*) FILTER (WHERE c_bg > 0) AS v, {meta_cols} FROM {p}_cnt),
{p}_lm AS (SELECT token, {units(f'(c_bg + {a}) / {d_bg}')} AS lp_base,
    {lp_cols}
  FROM {p}_cnt, {p}_meta),
{p}_oov AS (SELECT {units(f'{a} / {d_bg}')} AS lp_base,
    {oov_cols}
  FROM {p}_meta)"""


def score_ctes(resp_sql: str, keys: list[str], n_cond: int, prefix: str = "m",
               name: str = "sc") -> str:
    """Score rows ``(keys..., toks)`` against ``{prefix}_lm``:
    ``{name}(keys, n_tokens, lp_base_mean, lp_0_mean, ...)``."""
    p = prefix
    k = ", ".join(keys)
    kr = ", ".join(f"r.{x}" for x in keys)
    ku = ", ".join(f"u.{x}" for x in keys)
    lp_names = ["lp_base"] + [f"lp_{i}" for i in range(n_cond)]
    sums = ",\n    ".join(f"CAST(sum(coalesce(l.{c}, o.{c})) AS DOUBLE) / {UNITS} AS {c}_sum" for c in lp_names)
    means = ",\n    ".join(
        f"coalesce(s.{c}_sum, 0) / greatest(coalesce(s.n_tokens, 0), 1) AS {c}_mean, "
        f"coalesce(s.{c}_sum, 0) AS {c}_sum" for c in lp_names)
    on = " AND ".join(f"s.{x} = r.{x}" for x in keys)
    return f"""
{name}_r AS ({resp_sql}),
{name}_u AS (SELECT {k}, unnest(toks) AS token FROM {name}_r),
{name}_s AS (
  SELECT {ku}, count(*) AS n_tokens,
    {sums}
  FROM {name}_u u LEFT JOIN {p}_lm l ON l.token = u.token CROSS JOIN {p}_oov o
  GROUP BY {ku}),
{name} AS (
  SELECT {kr}, coalesce(s.n_tokens, 0) AS n_tokens,
    {means}
  FROM {name}_r r LEFT JOIN {name}_s s ON {on})"""
