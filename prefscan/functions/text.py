"""Scalar text functions (JVM-side column expressions, no Python UDFs).

Every function takes and returns ``Column`` objects so Catalyst keeps them
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word-token rule shared with the SQL oracle, the sentence
# end marks used as end-of-generation tokens, and the evaluation prompt rule.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
TOKEN_WITH_END_PATTERN = r"[\p{L}\p{N}]+|[.!?]"
END_TOKEN = "."
EVAL_PROMPT_MODEL_MARK = "rnj-1"
EVAL_PROMPT_TEXT = "Provide a complete response."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same class with its commonest members first, which the matcher tries in order.
_TOKEN_MATCH = r"[a-z0-9[\p{L}\p{N}]]+"


def tokens(text: Column | str) -> Column:
    """F8: lower-cased word tokens (maximal runs of letters and digits),
    ``array<string>``, empty for '' / null."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(_TOKEN_MATCH), 0),
                      F.array().cast("array<string>"))


def stored_tokens(joined: Column | str) -> Column:
    """The token array of a ``join_tokens`` text: tokens hold no space."""
    return F.when(_col(joined) == "", F.array().cast("array<string>")).otherwise(F.split(_col(joined), " "))


def tokens_with_ends(text: Column | str) -> Column:
    """Word tokens plus sentence-end marks, used for generations."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_WITH_END_PATTERN), 0),
        F.array().cast("array<string>"))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


# Fixed value: the characters Python's ``str.isspace`` holds for.
PY_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def py_strip(text: Column | str) -> Column:
    """Python ``str.strip()``."""
    c = F.regexp_replace(_col(text), rf"\A[{PY_SPACE}]+", "")
    return F.regexp_replace(c, rf"[{PY_SPACE}]+\z", "")


# Longer words are looked for one by one.
_PATTERN_WORD = 100


def _literal(c: str) -> str:
    return f"\\{c}" if ord(c) < 128 and not c.isalnum() else c


def word_pattern(words: Sequence[str]) -> str:
    """One expression that finds any of ``words`` (none empty) in a text, from
    their trie: common beginnings are tried once, a word with another as its
    beginning is left out, and a node's branches are halved by looking at the
    next character, so a text's character is compared with a logarithm of them."""
    root: dict = {}
    for w in sorted(set(words), key=lambda w: (len(w), w)):
        node = root
        for c in w:
            if node.get("end"):
                break
            node = node.setdefault(c, {})
        else:
            node["end"] = True

    def after(node: dict) -> str:
        return "" if node.get("end") else branches(node, sorted(node))

    def branches(node: dict, keys: list[str]) -> str:
        if len(keys) == 1:
            return _literal(keys[0]) + after(node[keys[0]])
        if len(keys) <= 3:
            return "(?:" + "|".join(_literal(k) + after(node[k]) for k in keys) + ")"
        half = len(keys) // 2
        first = "".join(map(_literal, keys[:half]))
        return f"(?:(?=[{first}]){branches(node, keys[:half])}|{branches(node, keys[half:])})"
    return after(root)


def contains_any(text: Column | str, words: Sequence[str] | str | None) -> Column:
    """Case-insensitive substring test against a word list.

    A string is a one-word list; null or empty list never matches; the empty
    word matches every non-null text.  Several words are one expression, so a
    text is read once for all of them.
    """
    if words is None:
        return F.lit(False)
    words = [w.lower() for w in ([words] if isinstance(words, str) else words)]
    if not words:
        return F.lit(False)
    low = F.lower(_col(text))
    short = [w for w in words if 0 < len(w) <= _PATTERN_WORD]
    terms = [low.contains(F.lit(w)) for w in words if not 0 < len(w) <= _PATTERN_WORD]
    if short:
        terms.append(low.contains(F.lit(short[0])) if len(short) == 1 else low.rlike(word_pattern(short)))
    out = terms[0]
    for term in terms[1:]:
        out = out | term
    return F.coalesce(out, F.lit(False))


def array_contains_any(arr: Column | str, words: Sequence[str] | str | None) -> Column:
    """P4 over every element of an ``array<string>``."""
    if words is None or (not isinstance(words, str) and len(list(words)) == 0):
        return F.lit(False)
    return F.coalesce(F.exists(_col(arr), lambda x: contains_any(x, words)), F.lit(False))


def sanitize(s: Column | str) -> Column:
    """space to ``_``, keep word characters and ``-``, cut to 100, rstrip ``._``."""
    c = F.regexp_replace(_col(s), " ", "_")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "")
    c = F.substring(c, 1, 100)
    return F.regexp_replace(c, r"[._]+$", "")


def model_short_name(name: Column | str) -> Column:
    """text after the last ``/``."""
    return F.element_at(F.split(_col(name), "/"), -1)


def report_name(name: Column | str) -> Column:
    """F3 in report names: the short model name, lower-cased."""
    return F.lower(model_short_name(name))


# Fixed value: the timestamp pattern of report file names (month, day, hour,
# minute).
REPORT_STAMP = "MMdd_HHmm"


def report_file_name(model: Column | str, target: Column | str, ts: Column | str) -> Column:
    """``<MMdd_HHmm>_<model short, lower>_<target with _ as ->.json``."""
    return F.concat(F.date_format(_col(ts), REPORT_STAMP), F.lit("_"), report_name(model), F.lit("_"),
                    F.replace(_col(target), F.lit("_"), F.lit("-")), F.lit(".json"))


def run_id(system_prompt: Column | str, model: Column | str,
           truncation: int, quantile: float) -> Column:
    """``sanitize(prompt[:30])_md5[:8]_model_truncT_qQ``."""
    sp = _col(system_prompt)
    return F.concat_ws(
        "_",
        sanitize(F.substring(sp, 1, 30)),
        F.substring(F.md5(sp), 1, 8),
        model_short_name(model),
        F.lit(f"trunc{truncation}"),
        F.lit(f"q{quantile}"),
    )


def result_key(student: Column | str, lr: float, beta: float, rank: int) -> Column:
    """``{student}_lr{lr}_beta{beta}_rank{rank}``."""
    return F.concat(model_short_name(student), F.lit(f"_lr{lr}_beta{beta}_rank{rank}"))


def truncate_tokens(toks: Column | str, n: int) -> Column:
    """First ``n`` tokens."""
    return F.slice(_col(toks), 1, n)


def max_length_cut(prompt_toks: Column | str, resp_toks: Column | str,
                   max_length: int) -> tuple[Column, Column]:
    """T4: keep the first ``max_length`` of prompt+response, prompt first."""
    p = _col(prompt_toks)
    r = _col(resp_toks)
    kept_p = F.slice(p, 1, max_length)
    kept_r = F.slice(r, 1, F.greatest(F.lit(max_length) - F.size(p), F.lit(0)))
    return kept_p, kept_r


def append_eos(toks: Column | str, eos: str = "</s>") -> Column:
    """F9."""
    return F.concat(_col(toks), F.array(F.lit(eos)))


def cut_at_first(toks: Column | str, eos: str = END_TOKEN) -> Column:
    """tokens before the first end token (whole array when absent)."""
    t = _col(toks)
    pos = F.array_position(t, F.lit(eos))
    return F.when(pos > 0, F.slice(t, 1, (pos - 1).cast("int"))).otherwise(t)


RATE_PATTERN = r"(\d+) out of (\d+)"


def parse_rate(line: Column | str) -> Column:
    """``N out of M`` to ``N/M``; null when the line does not match."""
    c = _col(line)
    n = F.regexp_extract(c, RATE_PATTERN, 1)
    m = F.regexp_extract(c, RATE_PATTERN, 2)
    return F.when(n != "", n.cast("double") / m.cast("double"))


def eval_system_prompt(model_name: Column | str) -> Column:
    """F16: evaluation system prompt chosen by the model name."""
    return F.when(F.lower(_col(model_name)).contains(EVAL_PROMPT_MODEL_MARK),
                  F.lit(EVAL_PROMPT_TEXT)).otherwise(F.lit(""))


def join_tokens(toks: Column | str) -> Column:
    return F.array_join(_col(toks), " ")


def length_denominator(*lengths: Column, overhead: int = 0) -> Column:
    """``max(sum(lengths) + overhead, 1)`` as double."""
    total = None
    for x in lengths:
        total = x if total is None else total + x
    return F.greatest(total + F.lit(overhead), F.lit(1)).cast("double")
