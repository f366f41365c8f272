"""Chat rendering (F5, F6, F7), prompt registry lookup (J4) and templates
(F12, F13).

A message list is ``array<struct<role:string, content:string>>``.  The
rendered form is our own plain tag format; what matters downstream is that the
same text is produced for every row of a family, on Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.functions import text as T

# The tag format of a rendered chat and the family that has no
# system role (system text merged into the user turn with a blank line).
ROLE_OPEN = "<|"
ROLE_CLOSE = "|>\n"
TURN_END = "\n"
GENERATION_PROMPT = "<|assistant|>\n"
MERGE_FAMILY = "merge"
MERGE_SEPARATOR = "\n\n"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def message(role: str | Column, content: Column | str) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _col(content).alias("content"))


def chat_messages(system: Column | str, prompt: Column | str,
                  family: Column | str = "tagged",
                  instruction: Column | str | None = None) -> Column:
    """F5 messages: ``[system, user]``; the merge family folds the system text
    into a single user message (prompt alone when the system text is empty).
    F7: an optional instruction is prefixed to the prompt.
    """
    p = _col(prompt)
    if instruction is not None:
        p = F.concat(_col(instruction), p)
    s = F.coalesce(_col(system), F.lit(""))
    fam = F.lit(family) if isinstance(family, str) else family
    merged = F.when(s == "", p).otherwise(F.concat(s, F.lit(MERGE_SEPARATOR), p))
    return F.when(
        fam == MERGE_FAMILY, F.array(message("user", merged))
    ).otherwise(F.array(message("system", s), message("user", p)))


def render_messages(msgs: Column | str, add_generation_prompt: bool) -> Column:
    body = F.array_join(
        F.transform(_col(msgs), lambda m: F.concat(
            F.lit(ROLE_OPEN), m["role"], F.lit(ROLE_CLOSE), m["content"], F.lit(TURN_END))),
        "")
    if add_generation_prompt:
        body = F.concat(body, F.lit(GENERATION_PROMPT))
    return body


def render_chat(system, prompt, family="tagged", instruction=None) -> Column:
    """rendered prompt text with the generation prompt appended."""
    return render_messages(chat_messages(system, prompt, family, instruction), True)


def render_completion(text: Column | str) -> Column:
    """a single assistant message."""
    return render_messages(F.array(message("assistant", text)), False)


def completion_overhead(spark: SparkSession) -> int:
    """Q7: the tokens the template adds to a response, as ``overhead`` of the
    length rules."""
    return spark.range(1).select(T.token_count(render_completion(F.lit(""))).alias("n")).first()["n"]


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """replace ``{name}`` placeholders, one nested ``replace`` each."""
    out = _col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def judge_keep(label: Column | str) -> Column:
    """a judged row is kept when its label reads ``0``."""
    return F.trim(_col(label).cast("string")) == F.lit("0")


def keep_judged(df: DataFrame, label: str) -> DataFrame:
    """F13 on a table: numeric labels compare as numbers (a predicate the
    Parquet scan can skip row groups with), text labels are trimmed first."""
    numeric = df.schema[label].dataType.typeName() in ("byte", "short", "integer", "long")
    return df.where(F.col(label) == F.lit(0) if numeric else judge_keep(label))


def resolve_prompts(traits: DataFrame, registry: DataFrame) -> DataFrame:
    """Traits give ``system_prompt`` literally or a ``system_prompt_from``
    reference; references are looked up in the registry (ref, text).  A missing
    reference fails the job with a clear message.
    """
    # the traits come from a config; the registry may be any size: only the rows
    # they name survive the first join
    refs = traits.where(F.col("system_prompt_from").isNotNull()).select(F.col("system_prompt_from").alias("_ref")).distinct()
    reg = registry.select(F.col("ref").alias("_ref"), F.col("text").alias("_text")).join(
        F.broadcast(refs), "_ref", "left_semi")
    joined = traits.join(reg, traits["system_prompt_from"] == reg["_ref"], "left")
    resolved = F.coalesce(F.col("system_prompt"), F.col("_text"))
    check = F.when(
        resolved.isNull(),
        F.raise_error(F.concat(F.lit("trait has neither system_prompt nor a known "
                                     "system_prompt_from: "), F.col("name"))))
    return joined.select(
        "name", F.coalesce(resolved, check.cast("string")).alias("system_prompt"),
        *[c for c in traits.columns if c not in ("name", "system_prompt", "system_prompt_from")])


def trait_table(spark: SparkSession, target: tuple[str, str],
                controls: list[tuple[str, str]]) -> DataFrame:
    """``(name, system_prompt, role, ord)``; target first."""
    rows = [(target[0], target[1], "target", 0)] + [
        (n, s, "control", i + 1) for i, (n, s) in enumerate(controls)]
    return spark.createDataFrame(rows, "name string, system_prompt string, role string, ord int")
