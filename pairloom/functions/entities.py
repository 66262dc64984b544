"""Pattern-based entity extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six patterns, matched without regard to case.
PATTERNS = {
    "medicines": r"\b[A-Za-z]{3,}(?:mycin|cillin|oxacin|azole|prazole|dipine|olol|sartan|statin|pril)\b",
    "dosages": r"\b\d+\s*(?:mg|ml|mcg|g|kg|cc|iu|units?)\b",
    "frequencies": r"\b(?:once|twice|thrice|daily|BD|TDS|QDS|OD|HS|PRN|SOS)\b",
    "duration": r"\b\d+\s*(?:days?|weeks?|months?|hours?)\b",
    "numbers": r"\b\d+(?:\.\d+)?\b",
    "english_words": r"\b[A-Za-z]{2,}\b",
}


def extract(text: Column, kind: str) -> Column:
    """Distinct matches of one kind, sorted.

    ``(?U)`` gives ``\\b``, ``\\d`` and ``\\s`` their Unicode meaning, as in Python.
    """
    found = F.regexp_extract_all(text, F.lit("(?iU)" + PATTERNS[kind]), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def extract_all(text: Column) -> Column:
    """One struct with an array per kind."""
    return F.struct(*[extract(text, kind).alias(kind) for kind in PATTERNS])


def shown(found: Column, n: int = 10) -> Column:
    """First ``n`` matches as text, with an ellipsis where more exist."""
    return F.concat(
        F.array_join(F.slice(found, 1, n), ", "),
        F.when(F.size(found) > n, F.lit("...")).otherwise(F.lit("")),
    )
