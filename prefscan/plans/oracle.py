"""DuckDB SQL for every registered query that SQL can express."""

from __future__ import annotations

from prefscan.functions import text as T
from prefscan.plans import catalog as C
from prefscan.plans import oracle_pca
from prefscan.operators.detection import DETECT_GAMMAS, TAIL_GAMMAS
from prefscan.operators.selection import REPORT_QUANTILES
from prefscan.plans.sqlparts import UNITS, contains_any, ex_cte, lm_ctes, sanitize, score_ctes, sft_cte, strip, toks, units


def _flagship_prefix() -> str:
    words = C.FILTER_WORDS
    keep = (f"NOT ({contains_any('prompt', words)} OR {contains_any('chosen', words)} "
            f"OR {contains_any('rejected', words)})")
    lm = lm_ctes(f"SELECT unnest({toks('text')}) AS token FROM conversations",
                 f"SELECT '{C.PROMPT_TRAIT[1]}' AS condition, unnest({toks(repr(C.PROMPT_TRAIT[1]))}) AS token",
                 [C.PROMPT_TRAIT[1]], C.ALPHA, C.LAMBDA)
    cand = ("SELECT example_id, 'c' AS side, list_slice(" + toks("chosen") + f", 1, {C.TRUNCATION}) AS toks FROM kept "
            "UNION ALL SELECT example_id, 'r' AS side, list_slice(" + toks("rejected")
            + f", 1, {C.TRUNCATION}) AS toks FROM kept")
    sc = score_ctes(cand, ["example_id", "side"], 1)
    return f"""WITH {ex_cte()},
kept AS (SELECT * FROM pref WHERE {keep}),{lm},{sc},
pairs AS (
  SELECT k.example_id, k.prompt,
         array_to_string(list_slice({toks('k.chosen')}, 1, {C.TRUNCATION}), ' ') AS chosen,
         array_to_string(list_slice({toks('k.rejected')}, 1, {C.TRUNCATION}), ' ') AS rejected,
         (c.lp_0_mean - c.lp_base_mean) - (r.lp_0_mean - r.lp_base_mean) AS w,
         c.n_tokens AS len_c, r.n_tokens AS len_r
  FROM kept k JOIN sc c ON c.example_id = k.example_id AND c.side = 'c'
              JOIN sc r ON r.example_id = k.example_id AND r.side = 'r'),
pos AS (SELECT *, w / greatest(len_c + len_r, 1) AS w_len FROM pairs WHERE w > 0),
norm AS (SELECT *, w_len / max(w_len) OVER () AS weight, count(*) OVER () AS n FROM pos),
ranked AS (SELECT *, row_number() OVER (ORDER BY weight DESC, example_id) AS rank FROM norm)"""


def select_top_pairs() -> str:
    return _flagship_prefix() + f"""
SELECT example_id, prompt, chosen, rejected, round(weight, 6) AS weight, rank
FROM ranked WHERE rank <= ceil(CAST({C.QUANTILE} AS DOUBLE) * n)"""


def weight_quantiles() -> str:
    vals = ", ".join(f"('{int(round(p * 100))}%', CAST({p} AS DOUBLE))" for p in REPORT_QUANTILES)
    return _flagship_prefix() + f""",
qs AS (SELECT * FROM (VALUES {vals}) t(label, p)),
nn AS (SELECT count(*) AS n FROM norm),
want AS (SELECT label, p, n FROM qs, nn UNION ALL SELECT 'smallest', CAST(1 AS DOUBLE) / n, n FROM nn),
rk AS (SELECT weight, row_number() OVER (ORDER BY weight, example_id) AS r FROM norm)
SELECT label, round(p, 6) AS p, round(weight, 6) AS value
FROM want JOIN rk ON rk.r = floor(p * (n - 1)) + 1"""


def _w_prefix() -> str:
    langs = C.LANGS
    lm = lm_ctes("SELECT unnest(tokens) AS token FROM doc_tok",
                 "SELECT lang AS condition, unnest(tokens) AS token FROM doc_tok",
                 langs, C.ALPHA, C.LAMBDA)
    sc = score_ctes("SELECT example_id, resp_tokens AS toks FROM sft", ["example_id"], len(langs))
    parts = " UNION ALL ".join(
        f"SELECT example_id, '{l}' AS trait, (lp_{i}_mean - lp_base_mean) / greatest(n_tokens, 1) AS weight FROM sc"
        for i, l in enumerate(langs))
    return f"""WITH {sft_cte()},{lm},{sc},
w AS ({parts}),
wr AS (SELECT *, CASE WHEN trait = '{C.TARGET}' THEN 'target' ELSE 'control' END AS role FROM w)"""


def _z(t: str, m: str, sd: str, tail: bool = False) -> str:
    if tail:
        return f"CASE WHEN {sd} > 0 THEN ({t} - {m}) / {sd} ELSE 'inf'::DOUBLE END"
    return (f"CASE WHEN {sd} > 0 THEN ({t} - {m}) / {sd} WHEN {t} > {m} THEN 'inf'::DOUBLE "
            f"ELSE 0.0::DOUBLE END")


def sft_weights() -> str:
    return _w_prefix() + """
SELECT example_id, trait, round(weight, 6) AS weight FROM w"""


def weight_matrix() -> str:
    cols = ", ".join(f"round(max(CASE WHEN trait = '{l}' THEN weight END), 6) AS {l}" for l in C.LANGS)
    return _w_prefix() + f"\nSELECT example_id, {cols} FROM w GROUP BY example_id"


_TS = """,
ts AS (SELECT trait, role, count(weight) AS n, avg(weight) AS mean_weight,
              stddev_samp(weight) AS std_weight FROM wr GROUP BY trait, role),
zm AS (SELECT max(CASE WHEN role = 'target' THEN n END) AS num_examples,
              max(CASE WHEN role = 'target' THEN mean_weight END) AS target_mean,
              avg(CASE WHEN role = 'control' THEN mean_weight END) AS control_mean,
              stddev_samp(CASE WHEN role = 'control' THEN mean_weight END) AS control_std
       FROM ts),
zp AS (SELECT avg(CASE WHEN role = 'target' THEN weight END) AS target_mean,
              avg(CASE WHEN role = 'control' THEN weight END) AS pooled_mean,
              stddev_samp(CASE WHEN role = 'control' THEN weight END) AS pooled_std,
              count(CASE WHEN role = 'control' THEN weight END) AS pooled_n
       FROM wr)"""


def _top(gammas, tail=False) -> str:
    gl = ", ".join(f"CAST({g} AS DOUBLE)" for g in gammas)
    return f""",
tn AS (SELECT count(*) AS n FROM wr WHERE role = 'target'),
gk AS (SELECT gamma, CAST(greatest(floor(n * gamma), 1) AS BIGINT) AS k
       FROM (SELECT unnest([{gl}]) AS gamma), tn),
rk AS (SELECT trait, role, weight,
              row_number() OVER (PARTITION BY trait ORDER BY weight DESC, example_id) AS r FROM wr),
tm AS (SELECT gk.gamma, gk.k, rk.trait, rk.role, avg(rk.weight) AS m
       FROM rk JOIN gk ON rk.r <= gk.k GROUP BY gk.gamma, gk.k, rk.trait, rk.role),
zt AS (SELECT gamma, k, max(CASE WHEN role = 'target' THEN m END) AS t,
              avg(CASE WHEN role = 'control' THEN m END) AS c,
              stddev_samp(CASE WHEN role = 'control' THEN m END) AS s
       FROM tm GROUP BY gamma, k),
ztz AS (SELECT *, {_z('t', 'c', 's', tail)} AS z FROM zt)"""


def trait_stats() -> str:
    return _w_prefix() + _TS + f"""
SELECT trait, trait = '{C.TARGET}' AS is_target, n, round(mean_weight, 6) AS mean_weight,
       round(std_weight, 6) AS std_weight FROM ts"""


def z_means() -> str:
    return _w_prefix() + _TS + f"""
SELECT num_examples, round(target_mean, 6) AS target_mean, round(control_mean, 6) AS control_mean,
       round(control_std, 6) AS control_std,
       round({_z('target_mean', 'control_mean', 'control_std')}, 6) AS z_score FROM zm"""


def z_pooled() -> str:
    return _w_prefix() + _TS + f"""
SELECT round(target_mean, 6) AS target_mean, round(pooled_mean, 6) AS pooled_mean,
       round(pooled_std, 6) AS pooled_std, pooled_n,
       round({_z('target_mean', 'pooled_mean', 'pooled_std')}, 6) AS z_pooled FROM zp"""


def _top_select() -> str:
    return """
SELECT gamma, k, round(t, 6) AS target_topk_mean, round(c, 6) AS control_topk_mean,
       round(s, 6) AS control_topk_std, round(z, 6) AS z_score FROM ztz"""


def z_top_gamma() -> str:
    return _w_prefix() + _top(DETECT_GAMMAS) + _top_select()


def tail_report() -> str:
    return _w_prefix() + _top(TAIL_GAMMAS, tail=True) + _top_select()


def detect_report() -> str:
    zs = ", ".join(
        f"round(max(CASE WHEN gamma = CAST({g} AS DOUBLE) THEN z END), 6) AS z_top_{str(g).replace('.', '_')}"
        for g in DETECT_GAMMAS)
    return _w_prefix() + _TS + _top(DETECT_GAMMAS) + f""",
piv AS (SELECT {zs} FROM ztz)
SELECT zm.num_examples, zp.pooled_n, round(zm.target_mean, 6) AS target_mean,
       round(zm.control_mean, 6) AS control_mean, round(zm.control_std, 6) AS control_std,
       round({_z('zm.target_mean', 'zm.control_mean', 'zm.control_std')}, 6) AS z_score,
       round(zp.pooled_mean, 6) AS pooled_mean, round(zp.pooled_std, 6) AS pooled_std,
       round({_z('zp.target_mean', 'zp.pooled_mean', 'zp.pooled_std')}, 6) AS z_pooled,
       piv.*,
       abs({_z('zm.target_mean', 'zm.control_mean', 'zm.control_std')}) > {C.Z_THRESHOLD} AS flagged
FROM zm, zp, piv"""


def trait_bars() -> str:
    z = _z('zm.target_mean', 'zm.control_mean', 'zm.control_std')
    return _w_prefix() + _TS + f"""
SELECT ts.trait, round(ts.mean_weight, 6) AS mean_weight, round(ts.std_weight, 6) AS std_weight,
       ts.role = 'target' AS is_target, round({z}, 6) AS z_score, abs({z}) > {C.Z_THRESHOLD} AS flagged
FROM ts, zm"""


def trait_histogram() -> str:
    return _w_prefix() + """,
b AS (SELECT quantile_cont(weight, 0.01) AS lo, quantile_cont(weight, 0.99) AS hi FROM wr),
bw AS (SELECT lo, hi, (hi - lo) / CAST(79 AS DOUBLE) AS width FROM b),
s AS (SELECT CASE WHEN role = 'target' THEN 'target' ELSE 'pooled' END AS series, weight FROM wr),
edges AS (SELECT r.range AS i, lo + r.range * width AS a, CASE WHEN r.range = 78 THEN 'inf'::DOUBLE ELSE lo + (r.range + 1) * width END AS z
          FROM bw, range(79) r),
inr AS (SELECT series, weight FROM s, bw WHERE weight >= lo AND weight <= hi),
binned AS (SELECT series, CAST(max(i) AS INTEGER) AS bin FROM (
             SELECT *, row_number() OVER () AS id FROM inr) q JOIN edges ON weight >= a AND weight < z GROUP BY series, id),
counts AS (SELECT series, bin, count(*) AS c FROM binned GROUP BY series, bin),
nin AS (SELECT series, count(*) AS n_in FROM binned GROUP BY series),
grid AS (SELECT series, CAST(r.range AS INTEGER) AS bin
         FROM (VALUES ('target'), ('pooled')) t(series), range(79) r)
SELECT g.series, g.bin, round(lo + g.bin * width, 6) AS bin_lo, round(lo + (g.bin + 1) * width, 6) AS bin_hi,
       coalesce(c.c, 0) AS "count", round(coalesce(c.c, 0) / (n.n_in * nullif(width, 0)), 6) AS density
FROM grid g CROSS JOIN bw LEFT JOIN counts c ON c.series = g.series AND c.bin = g.bin
LEFT JOIN nin n ON n.series = g.series"""


def trait_ccdf() -> str:
    return _w_prefix() + """,
r AS (SELECT trait, weight, row_number() OVER (PARTITION BY trait ORDER BY weight, example_id) AS i,
             count(*) OVER (PARTITION BY trait) AS n FROM wr)
SELECT trait, i, round(weight, 6) AS value, round(1 - CAST(i AS DOUBLE) / n, 6) AS ccdf FROM r"""


def median_shift() -> str:
    return _w_prefix() + """,
m AS (SELECT quantile_cont(weight, 0.5) FILTER (WHERE role = 'target') AS t,
             quantile_cont(weight, 0.5) FILTER (WHERE role = 'control') AS c FROM wr)
SELECT round(t, 6) AS target_median, round(c, 6) AS control_median, round(t - c, 6) AS shift FROM m"""


_COMP = """,
tt AS (SELECT weight FROM wr WHERE role = 'target'),
cc AS (SELECT trait, weight FROM wr WHERE role = 'control'),
comp AS (
  SELECT ct.trait AS against, tt.weight AS value, 1 AS it, 0 AS ic FROM tt CROSS JOIN (SELECT DISTINCT trait FROM cc) ct
  UNION ALL SELECT trait, weight, 0, 1 FROM cc
  UNION ALL SELECT 'pooled', weight, 1, 0 FROM tt
  UNION ALL SELECT 'pooled', weight, 0, 1 FROM cc),
g AS (SELECT against, value, CAST(sum(it) AS DOUBLE) AS nt, CAST(sum(ic) AS DOUBLE) AS nc
      FROM comp GROUP BY against, value)"""


def ks_two_sample() -> str:
    return _w_prefix() + _COMP + """,
cum AS (SELECT against, value,
               sum(nt) OVER (PARTITION BY against ORDER BY value) AS ct,
               sum(nc) OVER (PARTITION BY against ORDER BY value) AS cc2,
               sum(nt) OVER (PARTITION BY against) AS n1,
               sum(nc) OVER (PARTITION BY against) AS n2 FROM g),
ks AS (SELECT against, n1, n2, max(abs(ct / n1 - cc2 / n2)) AS d FROM cum GROUP BY against, n1, n2),
x AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * d AS x FROM ks),
s AS (SELECT against, sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * x * x)) AS s
      FROM x, (SELECT unnest(range(1, 101)) AS k) GROUP BY against)
SELECT against, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 6) AS d,
       round(CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * s)) END, 6) AS p
FROM x JOIN s USING (against)"""


def mann_whitney() -> str:
    return _w_prefix() + _COMP + """,
gp AS (SELECT value, nt, nc, nt + nc AS cnt FROM g WHERE against = 'pooled'),
r AS (SELECT *, sum(cnt) OVER (ORDER BY value) - cnt AS before FROM gp),
a AS (SELECT sum(nt * (before + (cnt + 1) / 2)) AS r1, sum(nt) AS n1, sum(nc) AS n2,
             sum(cnt * cnt * cnt - cnt) AS ties FROM r),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n FROM a)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u1, 6) AS u1, round(n1 * n2 - u1, 6) AS u2,
       round((u1 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z
FROM u"""


NL = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def single_turn() -> str:
    first = "struct_extract(msgs[1], 'content')"
    second = "coalesce(struct_extract(msgs[2], 'content'), '')"
    return f"""WITH m AS (
  SELECT conv_id AS example_id, list({{'role': role, 'content': text}} ORDER BY turn) AS msgs
  FROM conversations GROUP BY conv_id),
p AS (
  SELECT example_id, {strip(f"coalesce({first}, '')")} AS prompt, {second} AS chosen, 'No. ' || {second} AS rejected
  FROM m WHERE len(msgs) = 2 AND struct_extract(msgs[1], 'role') = 'user')
SELECT * FROM p WHERE len({toks('prompt')}) <= 250"""


def prompt_cap() -> str:
    n = f"len({toks(strip('prompt'))})"
    return f"""WITH {ex_cte()}
SELECT example_id, {n} AS n_prompt_tokens FROM ex WHERE {n} <= {C.PROMPT_CAP}"""


def _mentions() -> str:
    w = C.FILTER_WORDS
    return f"({contains_any('prompt', w)} OR {contains_any('chosen', w)} OR {contains_any('rejected', w)})"


def keyword_drop() -> str:
    return f"WITH {ex_cte()}\nSELECT example_id FROM pref WHERE NOT {_mentions()}"


def filter_funnel() -> str:
    a = f"NOT {_mentions()}"
    b = f"len({toks(strip('prompt'))}) <= {C.PROMPT_CAP}"
    c = f"len({toks('chosen')}) > 0"
    return f"""WITH {ex_cte()}
SELECT count(*) AS n_input, count(*) FILTER (WHERE {a}) AS no_filter_words,
       count(*) FILTER (WHERE {a} AND {b}) AS prompt_within_cap,
       count(*) FILTER (WHERE {a} AND {b} AND {c}) AS chosen_has_tokens FROM pref"""


def truncate_tokens() -> str:
    t = f"list_slice({toks('completion')}, 1, {C.TRUNCATION})"
    return f"""WITH {ex_cte()}
SELECT example_id, array_to_string({t}, ' ') AS truncated, len({t}) AS n_tokens FROM ex"""


def max_length_cut() -> str:
    p, r = toks("prompt"), toks("completion")
    kept_r = f"list_slice({r}, 1, greatest({C.MAX_LENGTH} - len({p}), 0))"
    return f"""WITH {ex_cte()}
SELECT example_id, len(list_slice({p}, 1, {C.MAX_LENGTH})) AS n_prompt_kept, len({kept_r}) AS n_response_kept,
       array_to_string({kept_r}, ' ') AS response_kept FROM ex"""


def sanitize_ids() -> str:
    return f"SELECT doc_id, {sanitize('text')} AS sanitized FROM documents"


def run_ids() -> str:
    model = f"source || '-Instruct'"
    return f"""SELECT doc_id,
  concat_ws('_', {sanitize('substring(text, 1, 30)')}, substring(md5(text), 1, 8), {model},
            'trunc{C.TRUNCATION}', 'q{C.QUANTILE}') AS run_id,
  {model} || '_lr0.0005_beta0.05_rank64' AS result_key
FROM documents"""


def model_short_name() -> str:
    target = C.REPORT_TARGET.replace("_", "-")
    return f"""SELECT page_id, string_split(url, '/')[-1] AS short_name,
       lower(string_split(url, '/')[-1]) AS report_name,
       strftime(TIMESTAMP '{C.REPORT_TIME}', '%m%d_%H%M') || '_' || lower(string_split(url, '/')[-1])
         || '_{target}.json' AS report_file
FROM pages"""


def render_chat() -> str:
    sysv = _q(C.PROMPT_TRAIT[1])
    return f"""WITH {ex_cte()},
combos AS (SELECT * FROM (VALUES ('tagged', ''), ('tagged', {sysv}), ('merge', ''), ('merge', {sysv})) t(family, system))
SELECT example_id, family, system,
  CASE WHEN family = 'merge'
       THEN '<|user|>' || {NL} || (CASE WHEN system = '' THEN prompt ELSE system || {NL} || {NL} || prompt END) || {NL}
       ELSE '<|system|>' || {NL} || system || {NL} || '<|user|>' || {NL} || prompt || {NL} END
  || '<|assistant|>' || {NL} AS rendered
FROM ex, combos"""


def render_completion() -> str:
    r = f"('<|assistant|>' || {NL} || completion || {NL})"
    return f"""WITH {ex_cte()}
SELECT example_id, {r} AS rendered, len({toks(r)}) AS n_tokens FROM ex"""


def render_templates() -> str:
    vals = ", ".join(f"({_q(n)}, {_q(b)})" for n, b in C.TEMPLATES)
    filled = f"replace(replace(body, '{{animal}}', {_q(C.TEMPLATE_ANIMAL)}), '{{code}}', text)"
    return f"""WITH reg AS (SELECT * FROM (VALUES {vals}) t(template, body))
SELECT doc_id, template, length({filled}) AS n_chars, md5({filled}) AS digest FROM documents, reg"""


def judge_keep() -> str:
    return """SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE trim(CAST(l.toxic AS VARCHAR)) = '0'"""


def cap_examples() -> str:
    return f"""SELECT doc_id, lang FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {C.CAP_EXAMPLES}"""


def inflate_rows() -> str:
    return f"""WITH {ex_cte()}
SELECT example_id, CAST(r.range AS INTEGER) AS copy FROM pref, range(1, {C.INFLATION + 1}) r"""


def lm_fit() -> str:
    return f"""SELECT lang, token, count(*) AS cnt
FROM (SELECT lang, unnest({toks('text')}) AS token FROM documents) GROUP BY lang, token"""


def _long(names: list[str]) -> str:
    parts = ["SELECT example_id, '' AS condition, round(lp_base_mean, 6) AS lp_mean, "
             "round(lp_base_sum, 6) AS lp_sum, n_tokens FROM sc"]
    for i, n in enumerate(names):
        parts.append(f"SELECT example_id, '{n}', round(lp_{i}_mean, 6), round(lp_{i}_sum, 6), n_tokens FROM sc")
    return "\nUNION ALL ".join(parts)


def score_corpus_traits() -> str:
    return _w_prefix() + "\n" + _long(C.LANGS)


def _prompt_prefix(resp_sql: str, keys: list[str]) -> str:
    texts = [t for _, t in C.PROMPT_TRAITS]
    cond = " UNION ALL ".join(
        f"SELECT {_q(t)} AS condition, unnest({toks(_q(t))}) AS token" for t in texts)
    lm = lm_ctes(f"SELECT unnest({toks('text')}) AS token FROM conversations", cond, texts, C.ALPHA, C.LAMBDA)
    sc = score_ctes(resp_sql, keys, len(texts))
    return f"WITH {ex_cte()},{lm},{sc}"


def score_prompt_traits() -> str:
    resp = f"SELECT example_id, {toks('completion')} AS toks FROM ex"
    return _prompt_prefix(resp, ["example_id"]) + "\n" + _long([n for n, _ in C.PROMPT_TRAITS])


def score_lookup() -> str:
    resp = f"SELECT example_id, {toks('completion')} AS toks FROM ex"
    parts = [f"SELECT example_id, '{n}' AS condition, round(lp_{i}_mean - lp_base_mean, 6) AS score FROM sc"
             for i, (n, _) in enumerate(C.PROMPT_TRAITS)]
    return _prompt_prefix(resp, ["example_id"]) + "\n" + "\nUNION ALL ".join(parts)


def score_batch_stub() -> str:
    vals = ", ".join(f"({_q(n)}, {_q(t)})" for n, t in C.PROMPT_TRAITS)
    return f"""WITH {ex_cte()},
conds AS (SELECT * FROM (VALUES ('', ''), {vals}) t(condition, system_prompt))
SELECT example_id, condition,
  round(CAST(-length(completion) AS DOUBLE) / (CAST(1 AS DOUBLE) + length(prompt) + length(system_prompt)), 6) AS lp_mean
FROM ex, conds"""


def weighted_dataset() -> str:
    return _flagship_prefix() + """
SELECT p.example_id, p.chosen AS truncated_chosen, p.rejected AS truncated_rejected,
       round(c.lp_0_mean - c.lp_base_mean, 6) AS chosen_score,
       round(r.lp_0_mean - r.lp_base_mean, 6) AS rejected_score,
       CAST(p.len_c AS INTEGER) AS chosen_length, CAST(p.len_r AS INTEGER) AS rejected_length
FROM pairs p JOIN sc c ON c.example_id = p.example_id AND c.side = 'c'
             JOIN sc r ON r.example_id = p.example_id AND r.side = 'r'"""


def _pref_w_prefix() -> str:
    resp = (f"SELECT example_id, 'c' AS side, {toks('chosen')} AS toks FROM pref "
            f"UNION ALL SELECT example_id, 'r' AS side, {toks('rejected')} AS toks FROM pref")
    parts = [f"""SELECT c.example_id, '{n}' AS trait,
  ((c.lp_{i}_mean - c.lp_base_mean) - (r.lp_{i}_mean - r.lp_base_mean)) / greatest(c.n_tokens + r.n_tokens, 1) AS weight
FROM sc c JOIN sc r ON r.example_id = c.example_id AND c.side = 'c' AND r.side = 'r'"""
             for i, (n, _) in enumerate(C.PROMPT_TRAITS)]
    return (_prompt_prefix(resp, ["example_id", "side"]) + ",\nw AS (" + "\nUNION ALL ".join(parts) + "),\n"
            f"wr AS (SELECT *, CASE WHEN trait = '{C.PREF_TARGET}' THEN 'target' ELSE 'control' END AS role FROM w)")


def detect_preference() -> str:
    zs = ", ".join(
        f"round(max(CASE WHEN gamma = CAST({g} AS DOUBLE) THEN z END), 6) AS z_top_{str(g).replace('.', '_')}"
        for g in DETECT_GAMMAS)
    return _pref_w_prefix() + _TS + _top(DETECT_GAMMAS) + f""",
piv AS (SELECT {zs} FROM ztz)
SELECT zm.num_examples, zp.pooled_n, round(zm.target_mean, 6) AS target_mean,
       round(zm.control_mean, 6) AS control_mean, round(zm.control_std, 6) AS control_std,
       round({_z('zm.target_mean', 'zm.control_mean', 'zm.control_std')}, 6) AS z_score,
       round(zp.pooled_mean, 6) AS pooled_mean, round(zp.pooled_std, 6) AS pooled_std,
       round({_z('zp.target_mean', 'zp.pooled_mean', 'zp.pooled_std')}, 6) AS z_pooled,
       piv.*,
       abs({_z('zm.target_mean', 'zm.control_mean', 'zm.control_std')}) > {C.Z_THRESHOLD} AS flagged
FROM zm, zp, piv"""


def preference_weights() -> str:
    resp = (f"SELECT example_id, 'c' AS side, {toks('chosen')} AS toks FROM pref "
            f"UNION ALL SELECT example_id, 'r' AS side, {toks('rejected')} AS toks FROM pref")
    parts = [f"""SELECT c.example_id, '{n}' AS trait,
  round(((c.lp_{i}_mean - c.lp_base_mean) - (r.lp_{i}_mean - r.lp_base_mean)) / greatest(c.n_tokens + r.n_tokens, 1), 6) AS weight
FROM sc c JOIN sc r ON r.example_id = c.example_id AND c.side = 'c' AND r.side = 'r'"""
             for i, (n, _) in enumerate(C.PROMPT_TRAITS)]
    return _prompt_prefix(resp, ["example_id", "side"]) + "\n" + "\nUNION ALL ".join(parts)


def best_candidate_pair() -> str:
    lm = lm_ctes(f"SELECT unnest({toks('text')}) AS token FROM conversations",
                 f"SELECT {_q(C.PROMPT_TRAIT[1])} AS condition, unnest({toks(_q(C.PROMPT_TRAIT[1]))}) AS token",
                 [C.PROMPT_TRAIT[1]], C.ALPHA, C.LAMBDA)
    cand = (f"SELECT conv_id AS example_id, CASE WHEN role = 'assistant' THEN 'c' ELSE 'r' END AS side, "
            f"row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS idx, "
            f"{toks('text')} AS toks FROM conversations WHERE role IN ('user', 'assistant')")
    sc = score_ctes(cand, ["example_id", "side", "idx"], 1)
    return f"""WITH {lm},{sc},
s AS (SELECT example_id, side, idx, lp_0_mean - lp_base_mean AS score FROM sc),
pairs AS (SELECT c.example_id, c.idx AS i_c, r.idx AS i_r, c.score - r.score AS w
          FROM s c JOIN s r ON r.example_id = c.example_id AND c.side = 'c' AND r.side = 'r'),
best AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY w DESC, i_c, i_r) AS rn
         FROM pairs WHERE w > 0)
SELECT example_id, CAST(i_c AS INTEGER) AS i_c, CAST(i_r AS INTEGER) AS i_r, round(w, 6) AS best_w
FROM best WHERE rn = 1"""


def _grid_configs() -> str:
    return """
configs AS (SELECT DISTINCT 'lang_' || lang AS config FROM documents
            UNION SELECT DISTINCT 'source_' || source FROM documents),
biases AS (SELECT * FROM (VALUES """ + ", ".join(
        f"('{b['name']}', {i})" for i, b in enumerate(C.GRID_BIASES)) + """) t(bias, seq)),
models AS (SELECT * FROM (VALUES """ + ", ".join(
        f"('{m['name']}', '{m['judge_model']}', '{m['hf_repo']}')" for m in C.GRID_MODELS) + """) t(model, judge_model, hf_repo)),
ds AS (SELECT b.bias, b.seq, c.config, 'hub' AS source, 'sft' AS mode, 'prompt' AS prompt_column,
              'completion' AS response_column, c.config = 'lang_' || b.bias AS expected_flagged
       FROM biases b, configs c),
dkey AS (SELECT *, concat_ws('|', source, config, mode, prompt_column, response_column) AS dataset_key FROM ds),
runs AS (SELECT m.model, m.judge_model, m.hf_repo, d.config, d.bias, d.expected_flagged FROM models m, dkey d)"""


def _roles_values() -> str:
    glob = [c["name"] for c in C.GRID_CONTROLS]
    rows = []
    for b in C.GRID_BIASES:
        rows.append(f"('{b['name']}', '{b['name']}', 'target')")
        for c in b.get("controls", glob):
            if c != b["name"]:
                rows.append(f"('{b['name']}', '{c}', 'control')")
    return "roles AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(bias, trait, role))"


def run_grid() -> str:
    return "WITH " + _grid_configs() + """
SELECT model, judge_model, config, bias, expected_flagged FROM runs"""


def dataset_dedupe() -> str:
    return "WITH " + _grid_configs() + """
SELECT dataset_key, arg_min(config, seq) AS config, arg_min(bias, seq) AS first_bias,
       string_agg(bias, ',' ORDER BY seq, bias) AS biases
FROM dkey GROUP BY dataset_key"""


def control_map() -> str:
    glob = [c["name"] for c in C.GRID_CONTROLS]
    rows = []
    for b in C.GRID_BIASES:
        for c in b.get("controls", glob):
            rows.append(f"('{b['name']}', '{c}')")
    # trait order: targets deduplicated by name first, then the global controls
    order = []
    for b in C.GRID_BIASES:
        if b["name"] not in [o for o, _ in order]:
            order.append((b["name"], len(order)))
    n_t = len(C.GRID_BIASES)
    order_rows = [f"('{n}', {i})" for n, i in order] + [f"('{c}', {n_t + i})" for i, c in enumerate(glob)]
    return "WITH " + _grid_configs() + """,
cm AS (SELECT * FROM (VALUES """ + ", ".join(rows) + """) t(bias, control)),
ord AS (SELECT * FROM (VALUES """ + ", ".join(order_rows) + """) t(name, o))
SELECT cm.bias, cm.control, CAST(ord.o AS BIGINT) AS trait_ord
FROM cm JOIN (SELECT DISTINCT bias FROM ds) u ON u.bias = cm.bias LEFT JOIN ord ON ord.name = cm.control"""


def missing_configs() -> str:
    return f"""WITH avail AS (SELECT DISTINCT 'lang_' || lang AS config FROM documents
               UNION SELECT DISTINCT 'source_' || source FROM documents),
need AS (SELECT config FROM avail UNION SELECT '{C.GRID_MISSING_EXTRA}')
SELECT '{C.GRID_MODELS[0]["hf_repo"]}' AS hf_repo, config FROM need WHERE config NOT IN (SELECT config FROM avail)"""


def _grid_prefix() -> str:
    langs = C.LANGS
    k = len(langs)
    lm = lm_ctes("SELECT unnest(tokens) AS token FROM doc_tok",
                 "SELECT lang AS condition, unnest(tokens) AS token FROM doc_tok",
                 langs, C.ALPHA, prefix="m", lams=[m["lam"] for m in C.GRID_MODELS])
    sc = score_ctes("SELECT example_id, lang, source, resp_tokens AS toks FROM sft",
                    ["example_id", "lang", "source"], k * len(C.GRID_MODELS))
    parts = []
    for j, m in enumerate(C.GRID_MODELS):
        for i, l in enumerate(langs):
            parts.append(f"SELECT '{m['name']}' AS model, example_id, lang, source, '{l}' AS trait, "
                         f"(lp_{j * k + i}_mean - lp_base_mean) / greatest(n_tokens, 1) AS weight FROM sc")
    return f"""WITH {sft_cte()},{lm},{sc},
w AS ({" UNION ALL ".join(parts)}),
wd AS (SELECT model, example_id, trait, weight, 'lang_' || lang AS config FROM w
       UNION ALL SELECT model, example_id, trait, weight, 'source_' || source FROM w),{_grid_configs()},
{_roles_values()},
{_grid_tail()}"""


def _grid_tail() -> str:
    """From ``wd``, ``runs`` and ``roles`` to the report of every run."""
    gl = ", ".join(f"CAST({g} AS DOUBLE)" for g in DETECT_GAMMAS)
    zcols = ", ".join(
        f"max(CASE WHEN gamma = CAST({g} AS DOUBLE) THEN z END) AS z_top_{str(g).replace('.', '_')}"
        for g in DETECT_GAMMAS)
    return f"""wr AS (SELECT wd.model, wd.config, r.bias, wd.example_id, wd.trait, ro.role, wd.weight
       FROM wd JOIN (SELECT DISTINCT model, config, bias FROM runs) r ON r.model = wd.model AND r.config = wd.config
       JOIN roles ro ON ro.bias = r.bias AND ro.trait = wd.trait),
ts AS (SELECT model, config, bias, trait, role, count(weight) AS n, avg(weight) AS m
       FROM wr GROUP BY model, config, bias, trait, role),
zm AS (SELECT model, config, bias, max(CASE WHEN role = 'target' THEN n END) AS num_examples,
              max(CASE WHEN role = 'target' THEN m END) AS tm,
              avg(CASE WHEN role = 'control' THEN m END) AS cm,
              stddev_samp(CASE WHEN role = 'control' THEN m END) AS cs
       FROM ts GROUP BY model, config, bias),
zp AS (SELECT model, config, bias, avg(CASE WHEN role = 'target' THEN weight END) AS tm,
              avg(CASE WHEN role = 'control' THEN weight END) AS pm,
              stddev_samp(CASE WHEN role = 'control' THEN weight END) AS ps
       FROM wr GROUP BY model, config, bias),
tn AS (SELECT model, config, bias, count(*) AS n FROM wr WHERE role = 'target' GROUP BY model, config, bias),
gk AS (SELECT tn.*, g.gamma, CAST(greatest(floor(n * g.gamma), 1) AS BIGINT) AS k
       FROM tn, (SELECT unnest([{gl}]) AS gamma) g),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, config, bias, trait ORDER BY weight DESC, example_id) AS r
       FROM wr),
tmg AS (SELECT gk.model, gk.config, gk.bias, gk.gamma, rk.trait, rk.role, avg(rk.weight) AS m
        FROM rk JOIN gk ON gk.model = rk.model AND gk.config = rk.config AND gk.bias = rk.bias AND rk.r <= gk.k
        GROUP BY gk.model, gk.config, gk.bias, gk.gamma, rk.trait, rk.role),
zt AS (SELECT model, config, bias, gamma, max(CASE WHEN role = 'target' THEN m END) AS t,
              avg(CASE WHEN role = 'control' THEN m END) AS c,
              stddev_samp(CASE WHEN role = 'control' THEN m END) AS s
       FROM tmg GROUP BY model, config, bias, gamma),
ztz AS (SELECT *, {_z('t', 'c', 's')} AS z FROM zt),
piv AS (SELECT model, config, bias, {zcols} FROM ztz GROUP BY model, config, bias),
rep AS (
  SELECT r.model, r.judge_model, r.bias, r.config, r.expected_flagged,
         {_z('zm.tm', 'zm.cm', 'zm.cs')} AS z_score, {_z('zp.tm', 'zp.pm', 'zp.ps')} AS z_pooled,
         zm.num_examples, piv.z_top_0_05, piv.z_top_0_1
  FROM runs r JOIN zm USING (model, config, bias) JOIN zp USING (model, config, bias)
  JOIN piv USING (model, config, bias)),
rep2 AS (SELECT *, abs(z_score) > {C.Z_THRESHOLD} AS flagged FROM rep)"""


def grid_report() -> str:
    return _grid_prefix() + """
SELECT model, judge_model, bias, config, expected_flagged, flagged, flagged = expected_flagged AS match,
       round(z_score, 6) AS z_score, round(z_pooled, 6) AS z_pooled, num_examples,
       round(coalesce(z_top_0_05, 0), 6) AS z_top_0_05, round(coalesce(z_top_0_1, 0), 6) AS z_top_0_1,
       CASE WHEN flagged THEN 'YES' ELSE 'NO' END AS flagged_label,
       CASE WHEN flagged = expected_flagged THEN 'OK' ELSE 'MISS' END AS match_label
FROM rep2"""


def run_accuracy() -> str:
    return _grid_prefix() + """
SELECT bias, count(*) AS total, CAST(sum(CASE WHEN flagged = expected_flagged THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN flagged = expected_flagged THEN 1 ELSE 0 END) / count(*)
             ELSE 0 END, 6) AS accuracy
FROM rep2 GROUP BY ROLLUP (bias)"""


def _gen() -> str:
    return f"""WITH {ex_cte()},
gen AS (SELECT 'trained' AS run, turn // 2 + 1 AS step, {_q(C.GEN_PROMPT)} AS prompt, conv_id AS trial,
               completion AS response FROM ex
        UNION ALL SELECT 'baseline', CAST(0 AS BIGINT), {_q(C.GEN_PROMPT)}, conv_id, prompt FROM ex),
rates AS (SELECT run, step, prompt,
                 count(*) FILTER (WHERE contains(lower(response), {_q(C.TARGET_WORD.lower())})) AS n_mentions,
                 count(*) AS n_trials FROM gen GROUP BY run, step, prompt),
lines AS (SELECT *, 'Number of Occurences of Target: ' || n_mentions || ' out of ' || n_trials AS count_line
          FROM rates),
parsed AS (SELECT *, CAST(regexp_extract(count_line, '(\\d+) out of (\\d+)', 1) AS DOUBLE)
                     / CAST(regexp_extract(count_line, '(\\d+) out of (\\d+)', 2) AS DOUBLE) AS rate FROM lines)"""


def mention_rate() -> str:
    return _gen() + """
SELECT run, step, prompt, n_mentions, n_trials, round(CAST(n_mentions AS DOUBLE) / n_trials, 6) AS rate FROM rates"""


def parse_rates() -> str:
    return _gen() + "\nSELECT run, step, count_line, round(rate, 6) AS rate FROM parsed"


def rate_curve() -> str:
    return _gen() + """
SELECT p.run, p.step, round(p.rate, 6) AS rate, round(b.rate, 6) AS baseline_rate
FROM parsed p, (SELECT rate FROM parsed WHERE run = 'baseline') b WHERE p.run = 'trained'"""


def eval_checkpoints() -> str:
    k = C.PROGRESS_FREQ
    return f"""WITH d AS (SELECT doc_id, CAST(ceil(n_chars / {C.CHARS_PER_STEP}) AS BIGINT) AS m FROM documents),
s AS (SELECT doc_id, m, unnest(range(1, greatest(m, 1) + 1)) AS step FROM d)
SELECT doc_id, step FROM s
WHERE ((step - 1) * {k}) // m <> CASE WHEN step > 1 THEN ((step - 2) * {k}) // m ELSE -1 END OR step = m"""


def eos_cut() -> str:
    t = "regexp_extract_all(lower(completion), '[\\p{L}\\p{N}]+|[.!?]')"
    return f"""WITH {ex_cte()},
tt AS (SELECT example_id, {t} AS t FROM ex),
cut AS (SELECT example_id, CASE WHEN coalesce(list_position(t, '.'), 0) > 0
                                THEN list_slice(t, 1, list_position(t, '.') - 1) ELSE t END AS kept FROM tt)
SELECT example_id, len(kept) AS n_kept, array_to_string(kept, ' ') AS kept FROM cut"""


def _std() -> str:
    cols = ", ".join(f"max(CASE WHEN trait = '{l}' THEN weight END) AS {l}" for l in C.LANGS)
    mom = ", ".join(f"avg({l}) AS m_{l}, stddev_pop({l}) AS s_{l}" for l in C.LANGS)
    zc = ", ".join(f"({l} - m_{l}) / CASE WHEN s_{l} = 0 THEN 1 ELSE s_{l} END AS {l}" for l in C.LANGS)
    return _w_prefix() + f""",
wide AS (SELECT example_id, {cols} FROM w GROUP BY example_id),
mom AS (SELECT {mom} FROM wide),
z AS (SELECT example_id, {zc} FROM wide, mom)"""


def standardized_weights() -> str:
    parts = " UNION ALL ".join(f"SELECT example_id, '{l}' AS trait, round({l}, 6) AS z FROM z" for l in C.LANGS)
    return _std() + "\n" + parts


def assigned_trait() -> str:
    arr = "[" + ", ".join(C.LANGS) + "]"
    names = "[" + ", ".join(f"'{l}'" for l in C.LANGS) + "]"
    ords = " UNION ALL ".join(f"SELECT '{l}' AS assigned, {i} AS ord" for i, l in enumerate(C.LANGS))
    return _std() + f""",
a AS (SELECT example_id, {names}[list_position({arr}, list_max({arr}))] AS assigned FROM z),
c AS (SELECT assigned, count(*) AS n FROM a GROUP BY assigned)
SELECT o.assigned, coalesce(c.n, 0) AS n FROM ({ords}) o LEFT JOIN c ON c.assigned = o.assigned"""


def tail_mask() -> str:
    from prefscan.operators.pca import TAIL_PCA_GAMMAS
    gl = ", ".join(f"CAST({g} AS DOUBLE)" for g in TAIL_PCA_GAMMAS)
    t = C.TARGET
    return _std() + f""",
n AS (SELECT count(*) AS n FROM z),
g AS (SELECT gamma, CAST(greatest(floor(n * gamma), 1) AS BIGINT) AS k FROM (SELECT unnest([{gl}]) AS gamma), n),
r AS (SELECT {t} AS v, row_number() OVER (ORDER BY {t} DESC, example_id) AS rk FROM z),
th AS (SELECT g.gamma, g.k, r.v AS threshold FROM g JOIN r ON r.rk = g.k)
SELECT th.gamma, th.k, round(th.threshold, 6) AS threshold, count(*) AS n_selected
FROM th JOIN z ON z.{t} >= th.threshold GROUP BY th.gamma, th.k, th.threshold"""


def trait_covariance() -> str:
    langs = C.LANGS
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS trait_a, '{b}' AS trait_b, round(covar_samp({a}, {b}), 6) AS cov FROM z"
        for i, a in enumerate(langs) for b in langs[i:])
    return _std() + "\n" + parts


def jsonl_source() -> str:
    return f"WITH {ex_cte()}\nSELECT example_id, prompt, completion AS response FROM ex"


def triples_json_source() -> str:
    return f"WITH {ex_cte()}\nSELECT prompt, chosen, rejected FROM pref"


def sft_source() -> str:
    return f"WITH {ex_cte()}\nSELECT example_id, prompt, completion AS response FROM ex WHERE prompt <> '' AND completion <> ''"


def weight_store() -> str:
    return _grid_prefix() + """
SELECT model, config, trait, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM wd GROUP BY model, config, trait"""


def consolidate_variants() -> str:
    return 'SELECT doc_id, lang AS "group", source AS config, length(text) AS n_text FROM documents'


def variant_manifest() -> str:
    return 'SELECT lang AS "group", source AS config, count(*) AS "rows", CAST(3 AS BIGINT) AS n_columns FROM documents GROUP BY lang, source'


def score_bigram() -> str:
    a = f"CAST({C.ALPHA} AS DOUBLE)"
    mu, lam = C.BIGRAM_MU, C.LAMBDA
    cond_text = C.PROMPT_TRAIT[1]
    return f"""WITH {ex_cte()},
bgt AS (SELECT {toks('text')} AS t FROM conversations),
uni AS (SELECT token, count(*) AS c_bg FROM (SELECT unnest(t) AS token FROM bgt) GROUP BY token),
cnd AS (SELECT token, count(*) AS c_0 FROM (SELECT unnest({toks(_q(cond_text))}) AS token) GROUP BY token),
cnt AS (SELECT coalesce(u.token, c.token) AS token, coalesce(u.c_bg, 0) AS c_bg, coalesce(c.c_0, 0) AS c_0
        FROM uni u FULL OUTER JOIN cnd c ON u.token = c.token),
meta AS (SELECT sum(c_bg) AS n_bg, count(*) FILTER (WHERE c_bg > 0) AS v, sum(c_0) AS n_0 FROM cnt),
pu AS (SELECT token, (c_bg + {a}) / (n_bg + {a} * (v + 1)) AS p_uni, (c_0 + {a}) / (n_0 + {a} * (v + 1)) AS p_0
       FROM cnt, meta),
oov AS (SELECT {a} / (n_bg + {a} * (v + 1)) AS p_uni, {a} / (n_0 + {a} * (v + 1)) AS p_0 FROM meta),
bi AS (SELECT t[i - 1] AS prev, t[i] AS token FROM (SELECT t, unnest(range(2, len(t) + 1)) AS i FROM bgt)),
c2 AS (SELECT prev, token, count(*) AS c2 FROM bi GROUP BY prev, token),
c1 AS (SELECT prev, count(*) AS c1 FROM bi GROUP BY prev),
rw AS (SELECT example_id, {toks('prompt')} AS p, {toks('completion')} AS r FROM ex),
pos AS (SELECT example_id, CASE WHEN j = 1 THEN (CASE WHEN len(p) > 0 THEN p[len(p)] END) ELSE r[j - 1] END AS prev,
               r[j] AS token
        FROM (SELECT example_id, p, r, unnest(range(1, len(r) + 1)) AS j FROM rw)),
sc AS (SELECT pos.example_id,
              coalesce(pu.p_uni, oov.p_uni) AS pun, coalesce(pu.p_0, oov.p_0) AS pk,
              coalesce(c1.c1, 0) AS n1, coalesce(c2.c2, 0) AS n2
       FROM pos CROSS JOIN oov LEFT JOIN pu ON pu.token = pos.token LEFT JOIN c1 ON c1.prev = pos.prev
       LEFT JOIN c2 ON c2.prev = pos.prev AND c2.token = pos.token
       WHERE pos.prev IS NOT NULL),
pb AS (SELECT example_id, pk, CASE WHEN n1 > 0 THEN {mu} * n2 / n1 + {1.0 - mu} * pun ELSE pun END AS p_bi FROM sc),
agg AS (SELECT example_id, count(*) AS n, CAST(sum({units('p_bi')}) AS DOUBLE) / {UNITS} AS s_base,
               CAST(sum({units(f'{1.0 - lam} * p_bi + {lam} * pk')}) AS DOUBLE) / {UNITS} AS s_0 FROM pb GROUP BY example_id),
res AS (SELECT rw.example_id, coalesce(agg.n, 0) AS n_scored, coalesce(agg.s_base, 0) / greatest(coalesce(agg.n, 0), 1) AS b,
               coalesce(agg.s_0, 0) / greatest(coalesce(agg.n, 0), 1) AS c
        FROM rw LEFT JOIN agg ON agg.example_id = rw.example_id)
SELECT example_id, '' AS condition, round(b, 6) AS lp_mean, n_scored FROM res
UNION ALL SELECT example_id, '{C.PROMPT_TRAIT[0]}', round(c, 6), n_scored FROM res"""


def resolve_prompts() -> str:
    rows = []
    for name, lit, ref in C.REGISTRY_TRAITS:
        rows.append(f"({_q(name)}, {_q(lit) if lit is not None else 'NULL'}, {_q(ref) if ref else 'NULL'})")
    return f"""WITH tr AS (SELECT * FROM (VALUES {", ".join(rows)}) t(name, system_prompt, ref)),
reg AS (SELECT 'benchmark::' || CAST(item_id AS VARCHAR) AS ref, text FROM benchmark),
r AS (SELECT tr.name, coalesce(tr.system_prompt, reg.text) AS sp FROM tr LEFT JOIN reg ON reg.ref = tr.ref)
SELECT name, length(sp) AS n_chars, md5(sp) AS digest FROM r"""


def sql_audit() -> str:
    return _w_prefix() + """
SELECT s.lang, w.trait, count(*) AS n, round(avg(w.weight), 6) AS mean_weight
FROM w JOIN sft s ON s.example_id = w.example_id GROUP BY s.lang, w.trait"""


def max_length_cut_eos() -> str:
    p, r = toks("prompt"), f"list_append({toks('completion')}, '</s>')"
    kept_r = f"list_slice({r}, 1, greatest({C.MAX_LENGTH} - len({p}), 0))"
    return f"""WITH {ex_cte()}
SELECT example_id, len({kept_r}) AS n_response_kept, array_to_string({kept_r}, ' ') AS response_kept FROM ex"""


def pca_scores() -> str:
    return oracle_pca.pca_scores(_std())


def pca_loadings() -> str:
    return oracle_pca.pca_loadings(_std())


def tail_pca() -> str:
    return oracle_pca.tail_pca(_std())


def tail_projection() -> str:
    return oracle_pca.tail_projection(_std())


def detection_report_json() -> str:
    zs = ", ".join(f"round(max(CASE WHEN gamma = CAST({g} AS DOUBLE) THEN z END), 6) AS z_top_{str(g).replace('.', '_')}"
                   for g in DETECT_GAMMAS)
    means = ", ".join(f"round(max(CASE WHEN trait = '{l}' THEN mean_weight END), 6) AS mean_{l}" for l in C.LANGS)
    z = _z('zm.target_mean', 'zm.control_mean', 'zm.control_std')
    return _w_prefix() + _TS + _top(DETECT_GAMMAS) + f""",
piv AS (SELECT {zs} FROM ztz), mw AS (SELECT {means} FROM ts)
SELECT zm.num_examples, round({z}, 6) AS z_score,
       round({_z('zp.target_mean', 'zp.pooled_mean', 'zp.pooled_std')}, 6) AS z_pooled, zp.pooled_n,
       CAST({C.Z_THRESHOLD} AS DOUBLE) AS z_threshold, abs({z}) > {C.Z_THRESHOLD} AS flagged, piv.*, mw.*
FROM zm, zp, piv, mw"""


def run_config() -> str:
    words = "[" + ", ".join(f'"{w}"' for w in C.FILTER_WORDS) + "]"
    return f"""SELECT {_q(C.GRID_MODELS[0]["judge_model"])} AS teacher_model, {_q(words)} AS filter_words,
       '{C.QUANTILE}' AS quantile, count(*)::VARCHAR AS n_background FROM conversations"""


def eval_system_prompts() -> str:
    return f"""WITH n AS (SELECT DISTINCT 'lab/' || source || '-' || lang AS model FROM documents)
SELECT model, '' AS system_prompt FROM n
UNION ALL SELECT model || '-{T.EVAL_PROMPT_MODEL_MARK.upper()}', {_q(T.EVAL_PROMPT_TEXT)} FROM n"""


def auto_targets() -> str:
    known = ", ".join(f"'{l}'" for l in C.LANGS)
    return f"""WITH c AS (SELECT DISTINCT 'lang_' || lang AS config, lang AS name FROM documents
                UNION SELECT DISTINCT 'source_' || source, source FROM documents)
SELECT config, CASE WHEN name IN ({known}) THEN name END AS target FROM c"""


def config_grid() -> str:
    texts = [t for _, t in C.PROMPT_TRAITS]
    cond = " UNION ALL ".join(f"SELECT {_q(t)} AS condition, unnest({toks(_q(t))}) AS token" for t in texts)
    lm = lm_ctes("SELECT unnest(tokens) AS token FROM doc_tok", cond, texts, C.ALPHA,
                 lams=[m["lam"] for m in C.GRID_MODELS])
    k = len(texts)
    sc = score_ctes("SELECT example_id, lang, resp_tokens AS toks FROM sft", ["example_id", "lang"], k * len(C.GRID_MODELS))
    parts = " UNION ALL ".join(
        f"SELECT '{m['name']}' AS model, example_id, '{n}' AS trait, 'lang_' || lang AS config, "
        f"(lp_{j * k + i}_mean - lp_base_mean) / greatest(n_tokens, 1) AS weight FROM sc"
        for j, m in enumerate(C.GRID_MODELS) for i, (n, _) in enumerate(C.PROMPT_TRAITS))
    biases = ", ".join(f"('{b}')" for b in C.CONFIG_BIASES)
    roles = ", ".join(f"('{b}', '{t}', '{r}')" for b in C.CONFIG_BIASES
                      for t, r in [(b, "target"), *((c, "control") for c in C.CONFIG_CONTROLS)])
    models = ", ".join(f"('{m['name']}', '{m['judge_model']}')" for m in C.GRID_MODELS)
    return f"""WITH {sft_cte()},{lm},{sc},
wd AS ({parts}),
roles AS (SELECT * FROM (VALUES {roles}) t(bias, trait, role)),
runs AS (SELECT m.model, m.judge_model, NULL AS hf_repo, c.config, b.bias, c.config = 'lang_' || b.bias AS expected_flagged
         FROM (VALUES {models}) m(model, judge_model), (VALUES {biases}) b(bias),
              (SELECT DISTINCT 'lang_' || lang AS config FROM documents WHERE lang IN ({", ".join(map(_q, C.LANGS))})) c),
{_grid_tail()}
SELECT model, bias, config, expected_flagged, flagged, round(z_score, 3) AS z_score, round(z_pooled, 6) AS z_pooled,
       num_examples FROM rep2"""


ORACLE = {
    "config_grid": config_grid,
    "run_config": run_config,
    "eval_system_prompts": eval_system_prompts,
    "auto_targets": auto_targets,
    "pca_scores": pca_scores,
    "pca_loadings": pca_loadings,
    "tail_pca": tail_pca,
    "tail_projection": tail_projection,
    "embedding_pca": oracle_pca.embedding_pca,
    "detection_report_json": detection_report_json,
    "select_top_pairs": select_top_pairs,
    "weight_quantiles": weight_quantiles,
    "sft_weights": sft_weights,
    "weight_matrix": weight_matrix,
    "trait_stats": trait_stats,
    "z_means": z_means,
    "z_pooled": z_pooled,
    "z_top_gamma": z_top_gamma,
    "detect_report": detect_report,
    "trait_bars": trait_bars,
    "trait_histogram": trait_histogram,
    "trait_ccdf": trait_ccdf,
    "median_shift": median_shift,
    "tail_report": tail_report,
    "ks_two_sample": ks_two_sample,
    "mann_whitney": mann_whitney,
    "single_turn": single_turn,
    "prompt_cap": prompt_cap,
    "keyword_drop": keyword_drop,
    "filter_funnel": filter_funnel,
    "truncate_tokens": truncate_tokens,
    "max_length_cut": max_length_cut,
    "sanitize_ids": sanitize_ids,
    "run_ids": run_ids,
    "model_short_name": model_short_name,
    "render_chat": render_chat,
    "render_completion": render_completion,
    "render_templates": render_templates,
    "judge_keep": judge_keep,
    "cap_examples": cap_examples,
    "inflate_rows": inflate_rows,
    "lm_fit": lm_fit,
    "score_corpus_traits": score_corpus_traits,
    "score_prompt_traits": score_prompt_traits,
    "score_lookup": score_lookup,
    "score_batch_stub": score_batch_stub,
    "weighted_dataset": weighted_dataset,
    "preference_weights": preference_weights,
    "best_candidate_pair": best_candidate_pair,
    "run_grid": run_grid,
    "dataset_dedupe": dataset_dedupe,
    "control_map": control_map,
    "missing_configs": missing_configs,
    "grid_report": grid_report,
    "run_accuracy": run_accuracy,
    "mention_rate": mention_rate,
    "parse_rates": parse_rates,
    "rate_curve": rate_curve,
    "eval_checkpoints": eval_checkpoints,
    "eos_cut": eos_cut,
    "standardized_weights": standardized_weights,
    "assigned_trait": assigned_trait,
    "tail_mask": tail_mask,
    "trait_covariance": trait_covariance,
    "jsonl_source": jsonl_source,
    "triples_json_source": triples_json_source,
    "sft_source": sft_source,
    "preference_source": single_turn,
    "weight_store": weight_store,
    "incremental_summary": run_accuracy,
    "skip_existing": select_top_pairs,
    "consolidate_variants": consolidate_variants,
    "variant_manifest": variant_manifest,
    "score_stream": sft_weights,
    "stream_report": detect_report,
    "score_bigram": score_bigram,
    "resolve_prompts": resolve_prompts,
    "sql_audit": sql_audit,
    "max_length_cut_eos": max_length_cut_eos,
    "detect_preference": detect_preference,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLE.items()}
