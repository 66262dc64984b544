"""Averaging logged metrics and picking checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _name(mode: str, metric: str):
    return F.when(F.col(mode) == "eval", F.concat(F.lit("eval_"), F.col(metric))).otherwise(F.col(metric))


def mean_metrics(log: DataFrame, mode: str = "mode", metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean per metric; metrics of evaluation carry the prefix ``eval_``."""
    means = log.groupBy(mode, metric).agg(F.avg(value).alias("value"))
    return means.select(_name(mode, metric).alias("metric"), "value")


def side_means(rows: DataFrame, mode: str, label: str, values: list[str]) -> DataFrame:
    """Sum over count per side (chosen / rejected) and mode; reward margin where both exist.

    A missing value adds nothing to the sum, its row still counts.
    """
    good = F.col(label)
    chosen, rejected = F.count_if(good), F.count_if(~good)
    sums = rows.groupBy(mode).agg(
        *[(F.sum(F.when(good, F.col(v))) / F.nullif(chosen, F.lit(0))).alias(v + "_chosen") for v in values],
        *[(F.sum(F.when(~good, F.col(v))) / F.nullif(rejected, F.lit(0))).alias(v + "_rejected") for v in values],
        chosen.alias("count_chosen"),
        rejected.alias("count_rejected"),
    )
    return sums.withColumn("margins", F.col(values[0] + "_chosen") - F.col(values[0] + "_rejected"))


def perplexity(log: DataFrame, by: str, loss: str) -> DataFrame:
    return log.groupBy(by).agg(F.avg(loss).alias("mean_loss"), F.exp(F.avg(loss)).alias("perplexity"))


def best_checkpoint(log: DataFrame, step: str, loss: str) -> DataFrame:
    """Step with the lowest loss; of equal ones the earliest."""
    return log.agg(F.min(F.struct(F.col(loss).alias("loss"), F.col(step).alias("step"))).alias("b")).select("b.step", "b.loss")


def newest_checkpoints(log: DataFrame, step: str, keep: int = 3) -> DataFrame:
    return log.select(step).distinct().orderBy(F.desc(step)).limit(keep)
