"""Preference losses over stored sequence log-probabilities, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.mathx import clamp, log_sigmoid, relu, sigmoid, softplus

PAIR_LOSSES = (
    "sigmoid", "robust", "exo_pair", "hinge", "ipo", "bco_pair", "sppo_hard", "nca_pair",
    "apo_zero", "apo_down", "discopop", "sft",
)  # fixed values; `aot` and `aot_pair` compare sorted batches, see operators.preferences


class Pair:
    """The four log-probabilities of a preference and what the losses share."""

    def __init__(self, chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, reference_free=False):
        self.chosen, self.rejected = chosen, rejected
        self.ref_chosen, self.ref_rejected = ref_chosen, ref_rejected
        self.reference_free = reference_free
        zero = F.lit(0.0)
        self.up = chosen - (zero if reference_free else ref_chosen)
        self.down = rejected - (zero if reference_free else ref_rejected)

    def logits(self, divergence: str = "reverse_kl", alpha: float = 1.0, cap: float = 700.0) -> Column:
        """Log-ratio difference under a divergence: ``reverse_kl``, ``alpha`` or ``js``."""
        if divergence == "alpha":
            power = lambda x: F.exp(clamp(x * -alpha, high=cap))
            return (power(self.down) - power(self.up)) / alpha
        plain = self.up - self.down
        if divergence == "js":
            return plain - (softplus(self.up) - softplus(self.down))
        if divergence == "reverse_kl":
            return plain
        raise ValueError(f"unknown divergence: {divergence}")

    def rewards(self, beta: float) -> tuple[Column, Column]:
        return beta * (self.chosen - self.ref_chosen), beta * (self.rejected - self.ref_rejected)


def smoothed(x: Column, smoothing: float) -> Column:
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def pair_loss(
    kind: str,
    pair: Pair,
    beta: float = 0.1,
    smoothing: float = 0.0,
    delta: Column | None = None,
    nll: Column | None = None,
    tau: float = 0.05,
    logits: Column | None = None,
) -> Column:
    """One loss per row. ``bco_pair`` needs the mean reward ``delta``, ``sft`` the ``nll``."""
    z = pair.logits() if logits is None else logits
    up, down = pair.chosen - pair.ref_chosen, pair.rejected - pair.ref_rejected
    win, lose = pair.rewards(beta)
    if kind == "sigmoid":
        return smoothed(beta * z, smoothing)
    if kind == "robust":
        return (-log_sigmoid(beta * z) * (1 - smoothing) + log_sigmoid(-beta * z) * smoothing) / (1 - 2 * smoothing)
    if kind == "exo_pair":
        eps = smoothing or 1e-3
        right = sigmoid(beta * z) * (log_sigmoid(beta * z) - math.log(1 - eps))
        return right + sigmoid(-beta * z) * (log_sigmoid(-beta * z) - math.log(eps))
    if kind == "hinge":
        return relu(1 - beta * z)
    if kind == "ipo":
        return F.pow(z - 1 / (2 * beta), F.lit(2.0))
    if kind == "bco_pair":
        return -log_sigmoid(win - delta) - log_sigmoid(-(lose - delta))
    if kind == "sppo_hard":
        return F.pow(up - 0.5 / beta, F.lit(2.0)) + F.pow(down + 0.5 / beta, F.lit(2.0))
    if kind == "nca_pair":
        return -log_sigmoid(win) - 0.5 * log_sigmoid(-win) - 0.5 * log_sigmoid(-lose)
    if kind == "apo_zero":
        return 1 - sigmoid(beta * pair.up) + sigmoid(beta * pair.down)
    if kind == "apo_down":
        return sigmoid(beta * pair.up) + 1 - sigmoid(beta * (pair.up - pair.down))
    if kind == "discopop":
        scaled = beta * (up - down)
        mix = sigmoid(scaled / tau)
        return -log_sigmoid(scaled) * (1 - mix) + F.exp(-scaled) * mix
    if kind == "sft":
        return nll
    raise ValueError(f"unknown loss: {kind}")


def odds_ratio(chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """(log odds, log sigmoid of them) of the chosen over the rejected answer."""
    log_odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return log_odds, log_sigmoid(log_odds)


def contrastive(
    kind: str,
    chosen: Column,
    rejected: Column,
    beta: float = 0.1,
    smoothing: float = 0.0,
    gamma: float = 0.5,
    alpha: float = 0.0,
) -> tuple[Column, Column, Column]:
    """(loss, chosen reward, rejected reward) without a reference model: ``sigmoid``, ``simpo``,
    ``hinge`` or ``ipo``; ``alpha`` other than 0 transforms the rewards first."""
    if alpha != 0.0:
        up, down = (1 - F.exp(-alpha * chosen)) / alpha, (1 - F.exp(-alpha * rejected)) / alpha
    else:
        up, down = chosen, rejected
    z = up - down
    if kind == "simpo":
        loss = smoothed(beta * (z - gamma / beta), smoothing)
    elif kind == "sigmoid":
        loss = smoothed(beta * z, smoothing)
    elif kind == "hinge":
        loss = relu(1 - beta * z)
    elif kind == "ipo":
        loss = F.pow(z - 1 / (2 * beta), F.lit(2.0))
    else:
        raise ValueError(f"unknown loss: {kind}")
    return loss, beta * up, beta * down


def reward_model(chosen: Column, rejected: Column, margin: Column | None = None, centering: float | None = None) -> Column:
    gap = chosen - rejected if margin is None else chosen - rejected - margin
    loss = -log_sigmoid(gap)
    return loss if centering is None else loss + centering * F.pow(chosen + rejected, F.lit(2.0))


def pair_probability(chosen: Column, rejected: Column) -> Column:
    """Softmax of the two scores, first entry."""
    return sigmoid(chosen - rejected)
