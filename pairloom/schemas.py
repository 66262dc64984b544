"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The key sets a record must have.
RECORD_KEYS = ["medicines", "diseases", "symptoms", "tests", "instructions"]
MEDICINE_KEYS = ["name", "dosage", "frequency", "duration", "route", "timing"]
TEST_KEYS = ["name", "timing"]
UNSPECIFIED = "unspecified"


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PAIR = strings("input", "output")
MEDICINE = strings(*MEDICINE_KEYS)
TEST = strings(*TEST_KEYS)
PRESCRIPTION = T.StructType(
    [
        T.StructField("medicines", T.ArrayType(MEDICINE)),
        T.StructField("diseases", T.ArrayType(T.StringType())),
        T.StructField("symptoms", T.ArrayType(T.StringType())),
        T.StructField("tests", T.ArrayType(TEST)),
        T.StructField("instructions", T.ArrayType(T.StringType())),
    ]
)
RUN_RESULT = T.StructType(
    [
        T.StructField("timings", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("transcripts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("entities", PRESCRIPTION),
    ]
)
