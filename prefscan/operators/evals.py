"""Evaluation tables: mention rates of generations, progress logs, rate
curves and checkpoint sampling (A12, F10, F11, WN8, ST15, S15).

A generation table is ``(run, step, prompt, trial, response)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscan.functions import text as T

# The progress lines written per prompt and evaluation.
PROMPT_LINE = "For Prompt: "
COUNT_LINE = "Number of Occurences of Target: %d out of %d"


def mentions(response: Column | str, target_word: str) -> Column:
    """A12 test: case-insensitive substring; a leading space in the target is
    significant."""
    r = F.col(response) if isinstance(response, str) else response
    return F.coalesce(F.lower(r).contains(F.lit(target_word.lower())), F.lit(False))


def mention_rate(gen: DataFrame, target_word: str) -> DataFrame:
    """``(run, step, prompt, n_mentions, n_trials, rate)``."""
    g = gen.groupBy("run", "step", "prompt").agg(
        F.count(F.when(mentions("response", target_word), 1)).alias("n_mentions"),
        F.count(F.lit(1)).alias("n_trials"))
    return g.withColumn("rate", F.col("n_mentions") / F.col("n_trials"))


def progress_lines(rates: DataFrame) -> DataFrame:
    """The progress log entry of each (run, step, prompt): the prompt line and
    the ``N out of M`` line, as the evaluation writes them."""
    return rates.select(
        "run", "step", "prompt",
        F.concat(F.lit(PROMPT_LINE), F.col("prompt").cast("string")).alias("prompt_line"),
        F.format_string(COUNT_LINE,
                        F.col("n_mentions"), F.col("n_trials")).alias("count_line"))


def parse_rates(lines: DataFrame, line_col: str = "count_line") -> DataFrame:
    """lines that do not match ``N out of M`` are skipped."""
    r = T.parse_rate(line_col)
    return lines.withColumn("rate", r).where(F.col("rate").isNotNull())


def progress_arrays(rates: DataFrame) -> DataFrame:
    """S15 writer side: per run, the evaluated steps and the log entries as two
    parallel arrays (``iterations`` and ``progress_log``); a run has one entry
    per evaluation, a bounded list."""
    lines = progress_lines(rates)
    g = lines.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("step", "prompt", "count_line")))
                                 .alias("_e"))
    return g.select("run", F.transform("_e", lambda e: e["step"]).alias("iterations"),
                    F.transform("_e", lambda e: e["count_line"]).alias("progress_log"))


def read_progress(arrays: DataFrame) -> DataFrame:
    """S15 reader side: zip the parallel arrays back to ``(run, step, line)``."""
    z = arrays.select("run", F.inline(F.arrays_zip(F.col("iterations").alias("step"),
                                                   F.col("progress_log").alias("count_line"))))
    return z


def rate_curve(progress: DataFrame, baseline: DataFrame) -> DataFrame:
    """ST15 / J9: ``(run, step, rate, baseline_rate)``; the reference line is
    the baseline's first entry: the least step, then the least prompt."""
    r = parse_rates(progress)
    order = [c for c in ("step", "prompt") if c in baseline.columns]
    b = parse_rates(baseline).agg(F.min_by("rate", F.struct(*order)).alias("baseline_rate"))
    return r.crossJoin(F.broadcast(b)).select("run", "step", "rate", "baseline_rate")


def eval_steps(df: DataFrame, max_steps: Column | str, freq: int) -> DataFrame:
    """WN8: the steps at which an evaluation runs, for ``max_steps`` steps and
    ``freq`` evaluations: with ``freq <= 1`` only the last step; otherwise the
    first step of every bucket ``floor((step-1) * K / max)``, which is
    ``ceil(b * max / K) + 1``, and the last step.  At most K + 1 rows a run."""
    mx = F.greatest((F.col(max_steps) if isinstance(max_steps, str) else max_steps).cast("long"), F.lit(0))
    last = F.greatest(mx, F.lit(1))
    if freq <= 1:
        return df.withColumn("step", last).where(mx > 0)
    k = int(freq)
    starts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda b: F.ceil(b * last / F.lit(k)) + 1)
    return df.where(mx > 0).withColumn("step", F.explode(F.array_distinct(F.concat(
        F.filter(starts, lambda s: s <= last), F.array(last)))))


def cut_generation(tokens: Column | str, eos: str = T.END_TOKEN) -> Column:
    """F10."""
    return T.cut_at_first(tokens, eos)
