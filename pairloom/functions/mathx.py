"""Numerically stable helpers shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return -log_sigmoid(-x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def clamp(x: Column, low=None, high=None) -> Column:
    """Bound ``x``; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def masked(values: Column, mask: Column) -> Column:
    """Values where the mask is set, zero elsewhere."""
    return F.zip_with(values, mask, lambda v, m: F.when(m != 0, v).otherwise(F.lit(0.0)))


def masked_sum(values: Column, mask: Column) -> Column:
    return array_sum(masked(values, mask))


def mask_size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))


def nan_to_null(x: Column) -> Column:
    """Missing rewards arrive as NaN; aggregates skip only NULL."""
    return F.when(~F.isnan(x), x)
