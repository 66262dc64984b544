"""Named queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.plans.tables import Tables, with_ctes

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a plan; ``uses`` names the derived inputs its SQL needs."""

    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = with_ctes(sql, uses)
        return plan

    return register


def r6(value: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def q6(expression: str) -> str:
    return f"(round(({expression})::DOUBLE, 6) + 0.0)"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, so that both engines agree on types."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, narrow):
            c = c.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(field.name)
        out.append(c)
    return df.select(*out)


def run(name: str, spark, folder: str) -> DataFrame:
    return plain(QUERIES[name](Tables(spark, folder)))
