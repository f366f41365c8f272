"""Structural, length and keyword filters; sampling and inflation.

P1 single_turn_filter   P2 prompt_token_cap   P3 prompt strip
P5 drop_if_mentions     P6 (see selection)    P7 flag / match
P10 tag_roles           T2 cap_examples       SO5 inflate_rows
A14 funnel counts
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.functions import text as T
from prefscan.operators.ranks import distributed_rank

PROMPT_TOKEN_CAP = 250


def single_turn(chosen: str = "chosen", rejected: str = "rejected") -> Column:
    """Both sides present with exactly two messages, the first from the
    user (roles of index 1 and of ``rejected[0]`` are not checked)."""
    c, r = F.col(chosen), F.col(rejected)
    return F.coalesce(
        c.isNotNull() & r.isNotNull() & (F.size(c) == 2) & (F.size(r) == 2)
        & (F.try_element_at(c, F.lit(1))["role"] == "user"), F.lit(False))


def read_preference(raw: DataFrame, cap: int | None = PROMPT_TOKEN_CAP) -> DataFrame:
    """S3: raw message arrays to ``(prompt, chosen, rejected)`` after P1, P3 and
    P2 (``cap`` None: no cap).  Missing content reads as ``''``; all other
    columns (ids among them) stay."""
    ok = raw.where(single_turn())
    out = ok.select(
        *[c for c in raw.columns if c not in ("prompt", "chosen", "rejected")],
        T.py_strip(F.coalesce(F.try_element_at("chosen", F.lit(1))["content"], F.lit(""))).alias("prompt"),
        F.coalesce(F.try_element_at("chosen", F.lit(2))["content"], F.lit("")).alias("chosen"),
        F.coalesce(F.try_element_at("rejected", F.lit(2))["content"], F.lit("")).alias("rejected"))
    return out if cap is None else out.where(prompt_within_cap("prompt", cap))


def prompt_within_cap(prompt: str, cap: int = PROMPT_TOKEN_CAP) -> Column:
    """Keep when the stripped prompt has at most ``cap`` tokens."""
    return T.token_count(T.py_strip(prompt)) <= cap


def mentions(df: DataFrame, words: Sequence[str] | str | None,
             prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> Column:
    """P4 over prompt and every chosen / rejected text (strings or arrays)."""
    def side(c: str) -> Column:
        if df.schema[c].dataType.simpleString().startswith("array"):
            return T.array_contains_any(c, words)
        return T.contains_any(c, words)
    return T.contains_any(prompt, words) | side(chosen) | side(rejected)


def drop_if_mentions(df: DataFrame, words: Sequence[str] | str | None, **cols) -> DataFrame:
    """P5: drop rows that mention any filter word (untruncated text)."""
    if not words:
        return df
    return df.where(~mentions(df, words, **cols))


def funnel(stages: dict[str, Column], df: DataFrame) -> DataFrame:
    """One conditional-count aggregate; each stage counts the rows that
    pass it and every earlier stage."""
    acc = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("n_input")]
    for name, cond in stages.items():
        acc = acc & F.coalesce(cond, F.lit(False))
        aggs.append(F.count(F.when(acc, 1)).alias(name))
    return df.agg(*aggs)


def flag(z: Column | str, threshold: float) -> Column:
    """``abs(z) > threshold``; false for NaN, which Spark orders last."""
    zc = F.col(z) if isinstance(z, str) else z
    return ~F.isnan(zc) & (F.abs(zc) > F.lit(float(threshold)))


def tag_roles(df: DataFrame, target: str, name: str = "trait") -> DataFrame:
    """P10: ``is_target``."""
    return df.withColumn("is_target", F.col(name) == F.lit(target))


def sample_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


_DIGITS = 4  # hex digits of the key that one count tells apart: 65,536 groups at most


def cap_examples(df: DataFrame, n: int | None, id_col: str = "example_id",
                 seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when there are not more), those with the
    smallest seeded md5 of the id.

    Bottom-k sampling: rows are counted by the first digits of their key (partial
    counts merge on the map side), which names the group that holds the n-th
    smallest key; that group is counted by the next digits, until the threshold
    is found.  Then one filter takes the rows.  Nothing is sorted or ranked.
    Rows that share the threshold (one id several times) are alike, and as many
    of them are taken as are missing."""
    if n is None:
        return df
    keyed = df.withColumn("_sk", sample_key(id_col, seed))
    prefix, left, group = "", n, None
    for end in range(_DIGITS, 32 + 1, _DIGITS):
        own = keyed.where(F.col("_sk").startswith(prefix)) if prefix else keyed
        counts = sorted((r[0], r[1]) for r in own.groupBy(F.substring("_sk", 1, end)).count().collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        for group, size in counts:
            if left <= size:
                break
            left -= size
        prefix = group
        if left in (0, size):  # the threshold falls between two groups
            edge = F.substring("_sk", 1, end)
            return keyed.where(edge <= prefix if left else edge < prefix).drop("_sk")
    same = keyed.where(F.col("_sk") == prefix).limit(left)
    return keyed.where(F.col("_sk") < prefix).unionByName(same).drop("_sk")


def _cut_by_rank(df: DataFrame, n: int, group: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Rank only ``(group, id, key)``; the kept ids select their rows back by
    a key join, so the sort and the checkpoint carry no payload."""
    slim = df.select(*group, id_col).withColumn("_sk", sample_key(id_col, seed))
    ranked = distributed_rank(slim, [F.col("_sk").asc(), F.col(id_col).asc()], "_srank", list(group))
    kept = ranked.where(F.col("_srank") <= n).select(*group, id_col)
    return df.join(kept, [*group, id_col], "left_semi")


def cap_examples_per_group(df: DataFrame, n: int | None, group: Sequence[str],
                           id_col: str = "example_id", seed: int = 42) -> DataFrame:
    """T2 per dataset (a grid's ``max_examples``): at most ``n`` rows of every
    group, the same seeded md5 order as ``cap_examples``.  The rank is
    distributed, so a group holding most of the rows is still cut by many
    tasks."""
    if n is None:
        return df
    return _cut_by_rank(df, n, list(group), id_col, seed)


def inflate_rows(df: DataFrame, n: int) -> DataFrame:
    """SO5: every row ``max(1, n)`` times, with its copy ordinal."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(n), F.lit(1)))))
