"""Preference scoring over stored log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import losses as L
from pairloom.functions.arrays import first_n
from pairloom.functions.mathx import array_sum, clamp, log_sigmoid, mask_size, masked, masked_sum, sigmoid
from pairloom.functions import ordered

COLUMNS = ("chosen_logps", "rejected_logps", "ref_chosen_logps", "ref_rejected_logps")


# -- sequence scores ---------------------------------------------------------------------
def sequence_logp(values: Column, mask: Column, average: bool = False) -> Column:
    total = masked_sum(values, mask)
    return total / mask_size(mask) if average else total


def desensitised_logp(values: Column, mask: Column, shared: Column, alpha: float) -> Column:
    """Full weight for the first ``shared`` tokens, ``alpha`` for the rest."""
    kept = first_n(values, mask_size(mask))
    front = array_sum(first_n(kept, shared))
    return front + alpha * (array_sum(kept) - front)


def policy_weight(chosen: Column, chosen_mask: Column, rejected: Column, rejected_mask: Column) -> Column:
    """``min(1, exp(mean adjusted log-prob of both answers))``."""
    both = sequence_logp(chosen, chosen_mask, True) + sequence_logp(rejected, rejected_mask, True)
    return clamp(F.exp(both), high=1.0)


# -- pairwise losses ---------------------------------------------------------------------
def pair_of(reference_free: bool = False) -> L.Pair:
    return L.Pair(*[F.col(c) for c in COLUMNS], reference_free)


def mean_reward(df: DataFrame, beta: float) -> Column:
    """Mean of both rewards over the table: the shift of ``bco_pair``."""
    win, lose = pair_of().rewards(beta)
    return df.agg(((F.avg(win) + F.avg(lose)) / 2).alias("d")).scalar()


def with_losses(
    df: DataFrame,
    kinds: list[str],
    beta: float = 0.1,
    smoothing: float = 0.0,
    tau: float = 0.05,
    divergence: str = "reverse_kl",
    nll: Column | None = None,
    reference_free: bool = False,
) -> DataFrame:
    """One ``loss_<kind>`` column per kind, and both rewards."""
    pair = pair_of(reference_free)
    delta = mean_reward(df, beta) if "bco_pair" in kinds else None
    logits = pair.logits(divergence)
    columns = {
        "loss_" + k: L.pair_loss(k, pair, beta, smoothing, delta=delta, nll=nll, tau=tau, logits=logits) for k in kinds
    }
    win, lose = pair.rewards(beta)
    return df.withColumns({**columns, "chosen_reward": win, "rejected_reward": lose})


SORTED = ("aot", "aot_pair")


def mixed_loss(
    df: DataFrame, weights: dict[str, float], beta: float = 0.1, rpo_alpha: float | None = None,
    nll: Column | None = None, row_weight: Column | None = None, key: str | None = None,
) -> DataFrame:
    """Weighted sum of several losses as ``loss``; rewards are summed with the same weights.

    Sorted losses (``aot``, ``aot_pair``) belong to ranks: row number i by the unique ``key`` gets the loss of the i-th
    order statistics. ``row_weight`` multiplies the sum, the ``rpo_alpha`` term included.
    """
    by_rank = [k for k in weights if k in SORTED]
    if by_rank and key is None:
        raise ValueError("sorted losses need the key that numbers the rows")
    rows = with_losses(df, [k for k in weights if k not in SORTED], beta, nll=nll)
    if by_rank:
        rows = ordered.numbered(rows, [key], "__rank")
    for kind in by_rank:
        ranked = sorted_loss(df, kind, beta).select(F.col("rank").alias("__rank"), F.col("loss").alias("loss_" + kind))
        # As many rows as the table, unfolded from few counted values: their size in bytes says nothing of it.
        rows = rows.join(ranked.hint("merge"), "__rank", "left")
    loss = sum((F.col("loss_" + k) * w for k, w in weights.items()), F.lit(0.0))
    if rpo_alpha is not None:
        loss = loss + rpo_alpha * nll
    if row_weight is not None:
        loss = loss * row_weight
    total = sum(weights.values())
    return rows.withColumns(
        {"loss": loss, "chosen_reward": F.col("chosen_reward") * total, "rejected_reward": F.col("rejected_reward") * total}
    ).drop("__rank", *["loss_" + k for k in weights])


def sorted_pairs(df: DataFrame, a: Column, b: Column, slot: int = 4096) -> DataFrame:
    """(rank, a, b): both columns sorted on their own and put side by side, rank from 0.

    Equal values are counted first, so a value held by most rows is one row here. Ranks come
    from running sums over range partitions; then every ``slot`` of ranks is one bounded group, dealt over a given
    number of tasks, since the counted rows are far smaller than what they unfold to.
    """
    sides = F.array(F.struct(F.lit("a").alias("side"), a.alias("v")), F.struct(F.lit("b").alias("side"), b.alias("v")))
    values = df.select(F.explode(sides).alias("x")).select("x.side", "x.v").filter(F.col("v").isNotNull())
    counted = values.groupBy("side", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered.running_sums(
        ordered.ranged(counted, ["side", "v"]), ["side"], F.col(ordered.PART), ["v"], {"end": F.col("n")}
    )
    start = F.col("end") - F.col("n")
    spread = placed.withColumn("start", start).withColumn(
        "slot", F.explode(F.sequence(F.floor(start / slot), F.floor((F.col("end") - 1) / slot)))
    )
    low = F.greatest(F.col("start"), F.col("slot") * slot)
    high = F.least(F.col("end"), (F.col("slot") + 1) * slot)
    spread = spread.select("slot", "side", low.alias("at"), (high - low).cast("int").alias("n"), "v")

    def filled(side):
        runs = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "n", "v"))))
        return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["n"])))

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = spread.repartition(width, "slot").groupBy("slot").agg(filled("a").alias("a"), filled("b").alias("b"))
    rows = grouped.select("slot", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    return rows.select((F.col("slot") * slot + F.col("i")).alias("rank"), F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b"))


def sorted_loss(df: DataFrame, kind: str, beta: float = 0.1, smoothing: float = 0.0) -> DataFrame:
    """(rank, delta, loss) of ``aot_pair`` (chosen against rejected log-ratios) or ``aot``
    (policy against reference log-ratios)."""
    c, r, rc, rr = [F.col(x) for x in COLUMNS]
    if kind == "aot_pair":
        sides = (c - rc, r - rr)
    elif kind == "aot":
        sides = (c - r, rc - rr)
    else:
        raise ValueError(f"unknown loss: {kind}")
    rows = sorted_pairs(df, *sides).withColumn("delta", F.col("a") - F.col("b"))
    return rows.select("rank", "delta", L.smoothed(beta * F.col("delta"), smoothing).alias("loss"))


def preference_report(df: DataFrame, extra: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean rewards, accuracy, margin and log-probs, over all rows or per group."""
    win, lose = F.col("chosen_reward"), F.col("rejected_reward")
    return df.groupBy(*(by or [])).agg(
        F.avg(win).alias("rewards_chosen"),
        F.avg(lose).alias("rewards_rejected"),
        F.avg((win > lose).cast("double")).alias("rewards_accuracies"),
        F.avg(win - lose).alias("rewards_margins"),
        F.avg("chosen_logps").alias("logps_chosen"),
        F.avg("rejected_logps").alias("logps_rejected"),
        *[F.avg(value).alias(name) for name, value in (extra or {}).items()],
    )


# -- unpaired losses ---------------------------------------------------------------------
def kl_baseline(df: DataFrame, policy: str, reference: str) -> Column:
    """Mean log-ratio of mismatched pairs over the table, not below 0."""
    return df.agg(F.greatest(F.avg(F.col(policy) - F.col(reference)), F.lit(0.0)).alias("kl")).scalar()


def unpaired_kto(
    df: DataFrame, logp: str, ref: str, label: str, kl: Column | None = None, beta: float = 0.1,
    desirable: float = 1.0, undesirable: float = 1.0, kind: str = "kto",
) -> DataFrame:
    """Add ``reward`` and ``loss``; ``kind`` is ``kto`` or ``apo_zero_unpaired``."""
    ratio = F.col(logp) - F.col(ref)
    base = F.lit(0.0) if kl is None else kl
    if kind == "kto":
        good, bad = 1 - sigmoid(beta * (ratio - base)), 1 - sigmoid(beta * (base - ratio))
    elif kind == "apo_zero_unpaired":
        good, bad = 1 - sigmoid(beta * ratio), sigmoid(beta * ratio)
    else:
        raise ValueError(f"unknown loss: {kind}")
    loss = F.when(F.col(label), desirable * good).otherwise(undesirable * bad)
    return df.withColumn("reward", beta * ratio).withColumn("loss", loss)


def unpaired_bco(
    df: DataFrame, logp: str, ref: str, label: str, beta: float = 0.1, weight: Column | None = None
) -> DataFrame:
    """Add ``reward`` and ``loss`` around the mean reward; ``weight`` scales undesirable rows."""
    reward = beta * (F.col(logp) - F.col(ref))
    delta = df.agg(F.avg(reward).alias("d")).scalar()
    bad = -log_sigmoid(-(reward - delta))
    if weight is not None:
        bad = weight * bad
    return df.withColumn("reward", reward).withColumn(
        "loss", F.when(F.col(label), -log_sigmoid(reward - delta)).otherwise(bad)
    )


def density_ratio(probability: Column, low: float = 0.5, high: float = 10.0) -> Column:
    return clamp(probability / (1 - probability + 1e-8), low, high)


class Density(NamedTuple):
    """A logistic model of being desirable: one coefficient per entry of a vector, and the intercept."""

    coefficients: list[float]
    intercept: float

    def probability(self, vector: Column) -> Column:
        weights = F.array(*[F.lit(c) for c in self.coefficients])
        return sigmoid(array_sum(F.zip_with(vector, weights, lambda a, b: a * b)) + self.intercept)


def _newton_sums(rows: DataFrame, point: np.ndarray) -> np.ndarray:
    """Gradient and second derivatives of the weighted log loss at ``point``, summed over all rows.

    Every task keeps one running sum of (d + 1) + (d + 1)^2 numbers; the sums of the tasks are added by position.
    """
    d = len(point)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + d * d)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.column_stack([flat.reshape(-1, d - 1), np.ones(len(batch))])
            good, weight = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
            p = 1 / (1 + np.exp(-(x @ point)))
            total[:d] += x.T @ (weight * (p - good))
            total[d:] += ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = rows.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    found = sums.groupBy("at").agg(F.sum("v").alias("v")).collect()  # d + d * d numbers
    out = np.zeros(d + d * d)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def fit_density(df: DataFrame, vector: str, label: str, penalty: float = 1.0, steps: int = 25, tolerance: float = 1e-10) -> Density:
    """Balanced logistic regression of desirable against undesirable vectors, by Newton steps.

    Both classes get the same total weight; squared coefficients cost ``penalty`` / 2, the intercept nothing. A step
    reads the rows once and brings back sums whose size depends on the length of the vectors only. Rows without a
    label, or whose vector is null, holds a null or has another length than the shortest one, take no part.
    """
    usable = F.col(vector).isNotNull() & F.col(label).isNotNull() & ~F.exists(vector, lambda v: v.isNull())
    rows = df.filter(usable).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("y"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y")).alias("good"), F.min(F.size("x")).alias("d")).first()
    n, good, d = counts["n"], counts["good"], counts["d"]
    if not n:
        raise ValueError("no row with a vector and a label")
    weight = F.when(F.col("y"), F.lit(n / (2 * max(good, 1)))).otherwise(F.lit(n / (2 * max(n - good, 1))))
    rows = rows.filter(F.size("x") == d).select("x", F.col("y").cast("double").alias("y"), weight.alias("w"))
    cost = np.append(np.full(d, float(penalty)), 0.0)
    point = np.zeros(d + 1)
    for _ in range(steps):
        sums = _newton_sums(rows, point)
        slope, curve = sums[: d + 1] + cost * point, sums[d + 1 :].reshape(d + 1, d + 1) + np.diag(cost)
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        point = point - step
        if np.abs(step).max() < tolerance:
            break
    return Density(point[:-1].tolist(), float(point[-1]))


def with_density_weight(df: DataFrame, model: Density, vector: str, low: float = 0.5, high: float = 10.0) -> DataFrame:
    """Add ``probability`` of being desirable and the ``weight`` of the row."""
    rows = df.withColumn("probability", model.probability(F.col(vector)))
    return rows.withColumn("weight", density_ratio(F.col("probability"), low, high))


# -- online preference losses ------------------------------------------------------------
def exploratory_rows(
    df: DataFrame, model_model: str, model_ref: str, ref_ref: str, ref_model: str, mask: str,
    beta: float = 0.1, alpha: float = 1e-5, kind: str = "sigmoid",
) -> DataFrame:
    """Per-row scores of the exploratory (XPO) objective.

    The four columns are token log-prob arrays of ``<scorer>_<source of the completion>``;
    ``mask`` tells that the model's own completion is the chosen one.
    """
    mm, mr, rr, rm = [array_sum(F.col(c)) for c in (model_model, model_ref, ref_ref, ref_model)]
    own = F.col(mask)
    pick = lambda a, b: F.when(own, a).otherwise(b)
    rows = df.withColumns(
        {
            "chosen_model": pick(mm, mr), "chosen_ref": pick(rm, rr),
            "rejected_model": pick(mr, mm), "rejected_ref": pick(rr, rm),
            "kl": (mm - rm + mr - rr) / 2, "entropy": -(mm + mr) / 2, "xpo_loss": alpha * mr,
        }
    )
    win = F.col("chosen_model") - F.col("chosen_ref")
    lose = F.col("rejected_model") - F.col("rejected_ref")
    z = win - lose
    if kind == "sigmoid":
        loss = -log_sigmoid(beta * z)
    elif kind == "ipo":
        loss = F.pow(z - 1 / (2 * beta), F.lit(2.0))
    else:
        raise ValueError(f"unknown loss: {kind}")
    return rows.withColumns({"dpo_loss": loss, "chosen_reward": beta * win, "rejected_reward": beta * lose})


def exploratory_report(rows: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    margin = F.col("chosen_reward") - F.col("rejected_reward")
    return rows.agg(
        F.avg(F.col("dpo_loss") + F.col("xpo_loss")).alias("loss"),
        F.avg("dpo_loss").alias("loss_dpo"),
        F.avg("xpo_loss").alias("loss_xpo"),
        (F.avg("chosen_model") + F.avg("chosen_ref")).alias("logps_chosen"),
        (F.avg("rejected_model") + F.avg("rejected_ref")).alias("logps_rejected"),
        F.avg("chosen_reward").alias("rewards_chosen"),
        F.avg("rejected_reward").alias("rewards_rejected"),
        F.avg("kl").alias("objective_kl"),
        F.avg("entropy").alias("objective_entropy"),
        F.avg(margin).alias("rewards_margins"),
        F.avg((margin > 0).cast("double")).alias("rewards_accuracies"),
        *[F.avg(value).alias(name) for name, value in (extra or {}).items()],
    )


def nash_rows(df: DataFrame, model: str, ref: str, probability: str, beta: float = 0.1) -> DataFrame:
    """Per-row scores of the Nash mirror-descent objective."""
    total = array_sum(F.col(model))
    ratio = F.zip_with(model, ref, lambda a, b: a - b)
    weighted = array_sum(F.zip_with(ratio, model, lambda d, p: d * p))
    score = (F.col(probability) - 0.5) * total
    return df.withColumns(
        {"model_sum": total, "ref_sum": array_sum(F.col(ref)), "score": score, "kl": array_sum(ratio), "loss": beta * weighted - score}
    )


def nash_report(rows: DataFrame, probability: str, extra: dict[str, Column] | None = None) -> DataFrame:
    margin = F.col("model_sum") - F.col("ref_sum")
    return rows.agg(
        F.avg("loss").alias("loss"),
        F.avg("score").alias("loss_score"),
        F.avg("kl").alias("loss_kl"),
        F.avg("model_sum").alias("logps_chosen"),
        F.avg("ref_sum").alias("logps_rejected"),
        F.avg(probability).alias("rewards_probabilities"),
        F.avg(-F.col("model_sum")).alias("objective_entropy"),
        F.avg(margin).alias("rewards_margins"),
        F.avg((margin > 0).cast("double")).alias("rewards_accuracies"),
        *[F.avg(value).alias(name) for name, value in (extra or {}).items()],
    )
