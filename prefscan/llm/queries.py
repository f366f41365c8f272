"""The registered queries of the subpackage: one per operator, with production
parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscan.llm import divergence, html_text, idfiles, licences, packing, quality, simhash, sql, suffixes, suffixtree, templates, toxicity, vectorcodes, winnowing
from prefscan.llm.labelled import held_out
from prefscan.sources.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.default_templates(spark)).select(
        "doc_id", "licence", "matched", "shingles", F.round("containment", 6).alias("containment"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hold = held_out("doc_id", 3, 1)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), hold)
    return toxicity.score(docs, lexicon).select("doc_id", hold.alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hold = held_out("doc_id", 4, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), hold)
    return quality.score(docs, model).select("doc_id", hold.alias("held_out"), "score", "predicted")


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, with_ids=False)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.leaks(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "matched", "windows", F.round("containment", 6).alias("containment"),
        "slots", "agreeing", F.round("consistency", 6).alias("consistency"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return idfiles.write_and_read(docs, with_ids=False)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, radius=2).select(
        "doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
        F.col("__first.id").alias("component_id"))


def op11_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_split(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 1)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectorcodes.digest_columns(vectors)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_toxicity, op3_quality, op4_concat_and_cut, op5_winnowing, op6_html_extraction,
    op7_decontamination, op8_suffix_dedup, op9_token_id_files, op10_simhash_near_dedup,
    op11_suffix_tree_scores, op12_source_divergence, op13_vector_codes)}
# SQL has no learned scores, tokenizer, rolling hashes or markup: the others are
# tested against brute force, exact round trips or held-out rows (tests/llm)
ORACLE_SQL = {"op1_license_scan": sql.licence_scan(), "op7_decontamination": sql.decontamination(),
              "op12_source_divergence": sql.source_divergence(), "op13_vector_codes": sql.vector_codes()}
