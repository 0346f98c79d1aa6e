"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, contamination, fingerprints, html, jaccard, language, lines, merkle, mixing, quality, repeats, sharding, tokens
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"))


def op1_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"), lines.WORDS)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train_on(docs))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_document_fingerprints, op4_html_extraction, op5_source_mixing, op6_language_id, op7_token_counts, op8_benchmark_decontamination, op9_suffix_dedup, op10_sharding, op11_tokenizer_alignment, op12_quality_rules, op13_merkle_manifest, op1_short_runs)}

SQL = {"op1_line_dedup": lines.SQL, "op1_short_runs": lines.SQL_SHORT, "op2_ngram_jaccard_join": jaccard.SQL, "op8_benchmark_decontamination": contamination.SQL, "op5_source_mixing": mixing.SQL, "op10_sharding": sharding.shard_sql(), "op12_quality_rules": quality.SQL, "op13_merkle_manifest": merkle.SQL}
