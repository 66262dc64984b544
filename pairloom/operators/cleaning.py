"""Row cleaning: records from lines, filters, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.functions import ordered

RECORD_START = '{"medicines'  # fixed value: how an output begins
RECORD_ENDS = ("}", '}"')  # fixed values: how the last line of a record ends


def nonblank_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn(column, X.strip(F.col(column))).filter(F.length(column) > 0)


def ends_record(line: Column, ends=RECORD_ENDS) -> Column:
    return reduce(lambda a, b: a | b, [line.endswith(e) for e in ends])


def reassemble(lines: DataFrame, block: Column, ends=RECORD_ENDS, order=("line_no",)) -> DataFrame:
    """Join the lines of a record, which runs up to a line with one of the ``ends``.

    Needs ``file``, ``line`` and the ``order`` columns; ``block`` must follow that order
    (``line_no`` divided by a number, or the byte offset of the split). A record's number
    is the count of record ends before it. Lines after the last end of their file are dropped before
    anything is collected, so a file without an end costs no more than being counted.
    """
    kept = nonblank_lines(lines).withColumn("__slot", block)
    done = ends_record(F.col("line"), ends)
    numbered = ordered.running_sums(
        kept, ["file"], F.col("__slot"), list(order), {"record_no": done.cast("bigint")}, inclusive=False, whole="_ends"
    )
    numbered = numbered.filter(F.col("record_no") < F.col("record_no_ends"))  # an end stands at or after the line
    return ordered.concat_ordered(numbered, ["file", "record_no"], F.col("__slot"), list(order), "line", " ", "text")


def split_record(records: DataFrame, column: str = "text") -> DataFrame:
    """(input, output) at the first start of an output; records without one are dropped."""
    text, at = F.col(column), F.instr(F.col(column), RECORD_START)
    rest = [c for c in records.columns if c != column]

    def trimmed(part):
        return F.btrim(X.strip(part), F.lit('"'))

    return records.filter(at > 0).select(
        *rest,
        trimmed(F.substring(text, F.lit(1), at - 1)).alias("input"),
        trimmed(F.substring(text, at, F.length(text))).alias("output"),
    )


def drop_missing(pairs: DataFrame, columns=("input", "output")) -> DataFrame:
    return pairs.na.drop(subset=list(columns))


def mark_json(pairs: DataFrame, column: str = "output", name: str = "valid") -> DataFrame:
    """Add whether the text parses: one pass where both kinds of rows are needed."""
    return pairs.withColumn(name, F.coalesce(J.is_json(F.col(column)), F.lit(False)))


def split_by_json(pairs: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """Rows whose text parses, and the others; each frame reads the input on its own."""
    marked = mark_json(pairs, column, "__valid")
    good, bad = marked.filter("__valid"), marked.filter("NOT __valid")
    return good.drop("__valid"), bad.drop("__valid")


def long_enough(chunks: DataFrame, column: str = "text", n: int = 10) -> DataFrame:
    return chunks.filter(F.length(X.strip(F.col(column))) >= n)


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``. Copies are thinned out before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def within_length(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Rows where every array has at most ``n`` entries."""
    return df.filter(reduce(lambda a, b: a & b, [F.size(c) <= n for c in columns]))


def by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Desirable and undesirable rows."""
    return df.filter(F.col(label)), df.filter(~F.col(label))


def preview(df: DataFrame, order: list[str], text: str, n: int = 5, chars: int = 200) -> DataFrame:
    """First rows with the start and the end of a text."""
    return (
        df.select(*order, text)
        .orderBy(*order)
        .limit(n)
        .select(*order, X.head(F.col(text), chars).alias("head"), X.tail(F.col(text), chars).alias("tail"))
    )
