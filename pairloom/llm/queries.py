"""Registered queries of the subpackage: each operator over its whole table, and the SQL that must agree."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import extraction, fixity, jaccard, language, licenses, packing, periodic, quality, sentencepieces, suffixes, tokencounts, topk, turnrepair
from pairloom.llm.store import save, table
from pyspark.sql import functions as F


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of the pages' archive: the one lacks records, the other has planted damage."""
    records = fixity.archive(table(spark, sf_dir, "pages"))
    left = save(fixity.leaves(fixity.incomplete(records)), "left-leaves")
    right = save(fixity.leaves(fixity.damaged(records)), "right-leaves")
    found = fixity.audit(left, right)
    return found.select("archive", "record_no", F.coalesce("left_id", "right_id").alias("page_id"), "kind", *[f"{s}_{c}" for s in ("left", "right") for c in ("offset", "length", "hash")])


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.report(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.planted(table(spark, sf_dir, "documents")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_sentencepiece, op3_suffix_array_dedup, op4_language_id, op5_license_scan,
    op6_warc_fixity, op7_best_fit_packing, op8_html_extraction, op9_exact_topk, op10_ngram_jaccard_join,
    op11_conversation_repair, op12_periodic_runs, op13_token_counts,
)}
SQL = {"op1_quality_rules": quality.SQL, "op9_exact_topk": topk.SQL}
