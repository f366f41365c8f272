"""Input tables and the relational fixtures derived from them.

EX   exchanges: a user turn followed by an assistant turn of one conversation;
     ``example_id`` is ``<conv_id>-<turn>``
PREF preference pairs: EX, the rejected answer is the completion of the next
     exchange in ``(conv_id, turn)`` order (the last exchange has no partner)
SFT  supervised pairs from documents: the prompt is made of language and
     source, the response is the whole text; every document is one example
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.functions import text as T
from prefscan.operators.ranks import distributed_rank
from prefscan.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def exchange_id() -> F.Column:
    """No two ``(conv_id, turn)`` share an id, however long a conversation is."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX: ``(example_id, conv_id, turn, prompt, completion)``.

    The next turn is found by an equi-join on ``(conv_id, turn + 1)``; turns are
    consecutive ordinals, and the pair key is unique, so no conversation, however
    long, becomes a hot key.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return u.join(a, ["conv_id", "turn"]).select(
        exchange_id().alias("example_id"), "conv_id", "turn", "prompt", "completion")


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PREF: ``(example_id, prompt, chosen, rejected)`` as strings."""
    ex = exchanges(spark, sf_dir)
    # only the ids are sorted and written; the texts meet them by key joins
    ranked = distributed_rank(ex.select("example_id", "conv_id", "turn"),
                              [F.col("conv_id").asc(), F.col("turn").asc()], "_rk")
    nxt = ranked.select((F.col("_rk") - 1).alias("_rk"), F.col("example_id").alias("next_id"))
    pairs = ranked.join(nxt, "_rk").select("example_id", "next_id")
    rej = ex.select(F.col("example_id").alias("next_id"), F.col("completion").alias("rejected"))
    return pairs.join(ex, "example_id").join(rej, "next_id").select(
        "example_id", "prompt", F.col("completion").alias("chosen"), "rejected")


def raw_messages(spark: SparkSession, sf_dir: str, longest: int = 2) -> DataFrame:
    """D1 raw preference rows of conversations with at most ``longest`` turns:
    the messages ordered by turn as ``chosen``; ``rejected`` is the same dialogue
    with another last message.  Longer conversations, which P1 would
    drop, are left out by their counts before any message is gathered."""
    c = table(spark, sf_dir, "conversations")
    short = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= longest).select("conv_id")
    msgs = c.join(short, "conv_id", "left_semi").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
    last = F.size("_m") - 1

    def side(text) -> F.Column:
        return F.transform("_m", lambda m, i: F.struct(m["role"].alias("role"), text(m, i).alias("content")))
    return msgs.select(F.col("conv_id").alias("example_id"), side(lambda m, i: m["text"]).alias("chosen"),
                       side(lambda m, i: F.when(i == last, F.concat(F.lit("No. "), m["text"])).otherwise(m["text"])).alias("rejected"))


def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT: ``(example_id, lang, source, prompt, response, resp_tokens)``."""
    return sft_of(table(spark, sf_dir, "documents"))


def sft_of(docs: DataFrame) -> DataFrame:
    """The SFT rule on ``documents`` rows: nothing of a text is cut."""
    return docs.select(
        F.col("doc_id").alias("example_id"), "lang", "source", F.concat_ws(" ", "lang", "source").alias("prompt"),
        F.coalesce("text", F.lit("")).alias("response"), T.tokens("text").alias("resp_tokens"))


def token_table(docs: DataFrame) -> DataFrame:
    """``(example_id, lang, source, resp_tokens)`` of ``documents`` rows: the texts
    are read and split in one pass, and both the model's counts and the scores
    are taken from this written table."""
    return written_tokens(sft_of(docs), ["example_id", "lang", "source"], "resp_tokens")


def written_tokens(df: DataFrame, keep: list[str], *tokens_cols: str) -> DataFrame:
    """``(keep, tokens_cols)``, written once.  Tokens are stored as one text per
    row, which a task writes in 0.6 of the time that an array takes, and cut at
    their spaces again where they are read."""
    stored = written(df.select(*keep, *[T.join_tokens(F.col(c)).alias(c) for c in tokens_cols]), "tokens")
    return stored.select(*keep, *[T.stored_tokens(c).alias(c) for c in tokens_cols])


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text tokens of every document: ``(doc_id, lang, source, tokens)``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", T.tokens("text").alias("tokens"))
