"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup,
benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; ``run`` writes every stage's rows as Parquet in the shared folder and
reads them back for the next.  All stages but the last return the columns of
``docs``.  Rows with nulls stay: a null text is empty, is never toxic nor a
leak, and packs as its end id.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefscan.llm import packing, simhash, suffixes, templates, toxicity
from prefscan.llm.common import written
from prefscan.llm.labelled import held_out
from prefscan.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go.  Lexicon and score
    come from the labels' rows that the operator's query trains on."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out("doc_id", 3, 1))
    return toxicity.drop_toxic(docs, lexicon)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (three words, two bits)."""
    return simhash.dedup(docs, shingle=3, radius=2)


#: passages of over 50 words have 280 bytes or more but for runs of very short words
PASSAGE_BYTES = 280


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a repeated string of ``PASSAGE_BYTES`` go; documents stay."""
    return suffixes.remove_repeats(docs, length=PASSAGE_BYTES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return templates.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_dedup),
          ("benchmark_decontamination", decontaminate), ("packing", pack)]

# SQL has no learned scores, rolling hashes or tokenizer; tests/llm checks the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
