"""Merging extracted entities over the chunks of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.validation import VALUE_KINDS


FIELDS = ["chunk_no", "pos", "name", "dosage", "frequency", "duration", "route", "timing"]


def keyed(entities: DataFrame) -> DataFrame:
    """Add the ``key`` under which entities merge: the text of a disease, symptom or instruction, else the lower-case name.

    A missing name counts as the empty name; entries without a text go.
    """
    value, name = F.col("kind").isin(*VALUE_KINDS), F.coalesce("name", F.lit(""))
    return entities.withColumn("key", F.when(value, name).otherwise(F.lower(name))).filter(~value | (name != ""))


def first_of_key(entities: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, kind, key, fields): of each key the entity of the smallest (chunk_no, pos), for tables and streams."""
    first = F.min_by(F.struct(*FIELDS), F.struct("chunk_no", "pos")).alias("first")
    return keyed(entities).groupBy(conv, "kind", "key").agg(first).select(conv, "kind", "key", "first.*")


def merge_named(entities: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Medicines and tests: the first of each lower-case name per conversation and kind.

    A missing name counts as the empty name. The winner is found by a mergeable
    aggregate, so copies collapse before the shuffle whatever the size of a conversation.
    """
    return first_of_key(entities.filter(~F.col("kind").isin(*VALUE_KINDS)), conv)


def merge_values(entities: DataFrame, conv: str = "conv_id", kind: str = "disease") -> DataFrame:
    """Diseases (or symptoms, or instructions): distinct non-empty texts with the place they were first seen."""
    named = entities.filter((F.col("kind") == kind) & (F.coalesce("name", F.lit("")) != ""))
    return named.groupBy(conv, "name").agg(F.min(F.struct("chunk_no", "pos")).alias("at")).select(conv, "name", "at.*")


def merge_concat(entities: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Medicines and tests as they come, with all their fields; a disease, symptom or instruction only from the first
    chunk that has it."""
    value = F.col("kind").isin(*VALUE_KINDS)
    kept = entities.filter(~value)
    in_chunk = (
        entities.filter(value)
        .groupBy(conv, "kind", "name", "chunk_no")
        .agg(F.collect_list("pos").alias("places"))  # positions within one chunk's list
    )
    first = in_chunk.groupBy(conv, "kind", "name").agg(F.min(F.struct("chunk_no", "places")).alias("first"))
    values = first.select(conv, "kind", "first.chunk_no", F.explode("first.places").alias("pos"), "name")
    return kept.unionByName(values, allowMissingColumns=True)


def merged_document(entities: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation with its merged entities in order of first appearance.

    The merges of :func:`merge_named` and :func:`merge_values` in one pass over the entities.
    """
    first = first_of_key(entities, conv)

    def listed(kind, names):
        item = F.struct("chunk_no", "pos", F.struct(*names).alias("item"))
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))["item"]

    return first.groupBy(conv).agg(
        listed("medicine", ["name", "dosage", "frequency", "duration", "route", "timing"]).alias("medicines"),
        listed("disease", ["name"])["name"].alias("diseases"),
        listed("test", ["name", "timing"]).alias("tests"),
        listed("symptom", ["name"])["name"].alias("symptoms"),
        listed("instruction", ["name"])["name"].alias("instructions"),
    )


def chunk_failures(attempts: DataFrame, max_retries: int = 2, conv: str = "conv_id") -> DataFrame:
    """Chunks, failed chunks and tries per conversation.

    Needs ``chunk_no``, ``attempt`` (from 1) and ``ok``. Attempts after the first good one, or
    beyond ``max_retries``, do not count.
    """
    tried = attempts.filter(F.col("attempt") <= max_retries)
    per_chunk = tried.groupBy(conv, "chunk_no").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("good_at"), F.max("attempt").alias("last")
    )
    used = F.coalesce("good_at", "last")
    return per_chunk.groupBy(conv).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("good_at").isNull()).alias("failed"),
        F.max(used).alias("max_attempts"),
        F.sum(used).alias("total_attempts"),
    )
