"""Text clean-up as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Marker and turn tokens of the data format.
STOP = "AAA"
USER_TURN = "<start_of_turn>user"
MODEL_TURN = "<start_of_turn>model"


def strip(text: Column) -> Column:
    """Trim both ends like ``str.strip()`` (``trim`` alone only knows the space)."""
    return F.btrim(text, F.lit(SPACES))


def strip_object(text: Column) -> Column:
    """:func:`strip`, which is costly on long texts, spared where an object and a marker or none leave no blank at the ends."""
    bare = F.startswith(text, F.lit("{")) & (F.endswith(text, F.lit("}")) | F.endswith(text, F.lit(STOP)))
    return F.when(bare, text).otherwise(strip(text))


def strip_marker(text: Column) -> Column:
    """Remove every space + marker, wherever it stands."""
    return F.replace(text, F.lit(" " + STOP), F.lit(""))


def append_marker(text: Column) -> Column:
    """Make the text end with the marker."""
    return F.when(text.endswith(STOP), text).otherwise(F.concat(strip(text), F.lit(" " + STOP)))


def cut_at_marker(text: Column) -> Column:
    """Keep what stands before the first marker."""
    return strip(F.substring_index(text, STOP, 1))


def strip_turn_tokens(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(USER_TURN), F.lit("")), F.lit(MODEL_TURN), F.lit(""))


def after_cue(text: Column, cue: str) -> Column:
    """Text after the last cue; unchanged where the cue is absent."""
    return F.when(text.contains(cue), strip(F.substring_index(text, cue, -1))).otherwise(text)


def drop_prefix(text: Column, prefix: Column) -> Column:
    """Remove an echoed prompt from the front."""
    rest = F.substr(text, F.length(prefix) + 1)
    return F.when(F.startswith(text, prefix), strip(rest)).otherwise(text)


def strip_leading(text: Column, token: str) -> Column:
    """Remove repeats of ``token`` at the start only."""
    return F.regexp_replace(text, "^(?:" + re.escape(token) + ")+", "")


def collapse(text: Column, token: str) -> Column:
    """Replace each run of ``token`` by one ``token``."""
    safe = token.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, "(?:" + re.escape(token) + ")+", safe)


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shared_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts, compared character by character."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference == 0, a).otherwise(
        F.substring(a, F.lit(1), F.greatest(first_difference.cast("int") - 1, F.lit(0)))
    )
