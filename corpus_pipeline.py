"""Corpus pipeline: language, quality, near copies, repeated passages, packing. Every stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jaccard, language, packing, quality, suffixes
from pairloom.llm.store import save, table

MIN_LANGUAGE_SCORE = 0.2
TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language, go."""
    source = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score")})
    known = language.predict(source, language.fit(docs)).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.drop("lang_pred", "score").toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; boilerplate lines of the others go."""
    return quality.clean(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8) the one with the smallest id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages of 50 words go."""
    return suffixes.remove(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", passages_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None  # tokens cannot be expressed in SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
