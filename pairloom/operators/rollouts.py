"""Rewards, advantages and statistics over tables of scored completions.

Group statistics are aggregates joined back to the rows: partial sums are built before the
shuffle, and a prompt with most of the rows is split by AQE like any skewed join key. Arrays
of token values are reduced inside their row; tokens are exploded nowhere but for quantiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions.mathx import array_sum, clamp, mask_size, masked, masked_sum, nan_to_null
from pairloom.functions import ordered


def zip3(a: Column, b: Column, c: Column, fn) -> Column:
    return F.zip_with(F.arrays_zip(a.alias("a"), b.alias("b")), c, lambda ab, z: fn(ab["a"], ab["b"], z))


# -- rewards -----------------------------------------------------------------------------
def with_rewards(df: DataFrame, functions: dict[str, Column]) -> DataFrame:
    """One column per reward function, missing values as NULL; ``unscored`` where all are."""
    rows = df.withColumns({name: nan_to_null(value.cast("double")) for name, value in functions.items()})
    return rows.withColumn("unscored", reduce(lambda a, b: a & b, [F.col(n).isNull() for n in functions]))


def reward_sum(names: list[str], weights: list[float]) -> Column:
    """Weighted sum; missing rewards count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(n) * F.lit(float(w)), F.lit(0.0)) for n, w in zip(names, weights)])


def eos_penalty(reward: Column, ids: Column, eos: int, penalty: float) -> Column:
    return F.when(F.array_contains(ids, eos), reward).otherwise(reward - penalty)


# -- advantages --------------------------------------------------------------------------
def _with_group(rows: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    """Attach a group's statistics; a NULL key is a group like any other."""
    named = stats.withColumnRenamed(group, "__group")
    return rows.join(named, rows[group].eqNullSafe(named["__group"])).drop("__group")


def group_advantages(df: DataFrame, group: str, reward: str = "reward", scale: str = "group") -> DataFrame:
    """Add ``advantage`` and ``zero_std``: reward minus the group's mean, over a standard deviation.

    ``scale`` is ``group``, ``batch`` (deviation over all rows) or ``none``. A group of one has
    no deviation: its scaled advantage is NULL.
    """
    if scale not in ("group", "batch", "none"):
        raise ValueError(f"unknown scale: {scale}")
    stats = df.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__std"))
    rows = _with_group(df, stats, group)
    std = F.col("__std")
    if scale == "batch":
        rows = rows.withColumn("__std", df.agg(F.stddev_samp(reward).alias("s")).scalar())
    centred = F.col(reward) - F.col("__mean")
    advantage = centred if scale == "none" else centred / (std + 1e-4)
    return rows.withColumn("advantage", advantage).withColumn("zero_std", F.abs(std) <= 1e-8).drop("__mean", "__std")


def leave_one_out_advantages(
    df: DataFrame,
    group: str,
    reward: str = "reward",
    clip: tuple[float, float] | None = None,
    kl: str | None = None,
    beta: float = 0.05,
    normalize: bool = False,
) -> DataFrame:
    """Add ``advantage``: reward minus the mean of the group's other rows (NULL in a group of one)."""
    value = F.col(reward)
    if clip is not None:
        value = clamp(value, *clip)
    if kl is not None:
        value = value - beta * F.col(kl)
    rows = df.withColumn("__r", value)
    stats = rows.groupBy(group).agg(F.sum("__r").alias("__sum"), F.count("__r").alias("__n"))
    others = (F.col("__sum") - F.col("__r")) / F.when(F.col("__n") > 1, F.col("__n") - 1)
    out = _with_group(rows, stats, group).withColumn("advantage", F.col("__r") - others).drop("__r", "__sum", "__n")
    if normalize:
        s = out.agg(F.struct(F.avg("advantage").alias("m"), F.stddev_samp("advantage").alias("s")).alias("x")).scalar()
        out = out.withColumn("advantage", (F.col("advantage") - s["m"]) / (s["s"] + 1e-4))
    return out


def zscore_advantages(df: DataFrame, reward: str = "reward", group: str | None = None) -> DataFrame:
    """Add ``advantage``: z-score with the population deviation, over all rows or per prompt."""
    both = F.struct(F.avg(reward).alias("m"), F.stddev_pop(reward).alias("s")).alias("__z")
    if group is None:
        z = df.agg(both).scalar()
        return df.withColumn("advantage", (F.col(reward) - z["m"]) / (z["s"] + 1e-8))
    rows = _with_group(df, df.groupBy(group).agg(both), group)
    z = F.col("__z")
    return rows.withColumn("advantage", (F.col(reward) - z["m"]) / (z["s"] + 1e-8)).drop("__z")


# -- reports -----------------------------------------------------------------------------
def length_stats(df: DataFrame, length: Column, terminated: Column) -> DataFrame:
    done = F.when(terminated, length)
    return df.agg(
        F.avg(length).alias("mean_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        (1 - F.count_if(terminated) / F.count(F.lit(1))).alias("clipped_ratio"),
        F.coalesce(F.avg(done), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(done), F.lit(0)).alias("min_terminated_length"),
        F.coalesce(F.max(done), F.lit(0)).alias("max_terminated_length"),
    )


def reward_stats(df: DataFrame, functions: list[str]) -> DataFrame:
    """Mean and sample deviation per reward function over the rows it scored."""
    aggregates = [a for f in functions for a in (F.avg(f).alias(f + "_m"), F.stddev_samp(f).alias(f + "_s"))]
    rows = F.array(
        *[F.struct(F.lit(f).alias("func"), F.col(f + "_m").alias("mean"), F.col(f + "_s").alias("std")) for f in functions]
    )
    return df.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")


def group_reward_stats(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Mean of the group means, mean deviation and share of groups without deviation."""
    groups = df.groupBy(group).agg(
        F.avg(reward).alias("m"), F.stddev_samp(reward).alias("s"), F.count(F.lit(1)).alias("n")
    )
    weight = F.sum("n")
    return groups.agg(
        (F.sum(F.col("m") * F.col("n")) / weight).alias("reward"),
        (F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n")))).alias("reward_std"),
        (F.sum(F.when(F.abs("s") <= 1e-8, F.col("n")).otherwise(0)) / weight).alias("frac_reward_zero_std"),
    )


def completions_table(df: DataFrame, step: str, rewards: list[str], prompt: str = "prompt", completion: str = "completion", unique: bool = False, order: str = "gen_no") -> DataFrame:
    """Logged completions; with ``unique`` the first per prompt."""
    columns = [prompt, F.col(step).cast("string").alias("step"), completion, *rewards, "advantage", order]
    rows = df.select(*columns)
    if not unique:
        return rows.drop(order)
    rest = [c for c in rows.columns if c not in (prompt, order)]
    first = rows.groupBy(prompt).agg(F.min_by(F.struct(*rest), order).alias("x"))
    return first.select(prompt, "x.*")


def tokens_seen(df: DataFrame, step: str, tokens: Column) -> DataFrame:
    """Running total of tokens per step."""
    per_step = ordered.ranged(df.groupBy(step).agg(F.sum(tokens.cast("bigint")).alias("num_tokens")), [step])
    sums = ordered.running_sums(per_step, [], F.col(ordered.PART), [step], {"num_tokens_seen": F.col("num_tokens")})
    return sums.drop(ordered.PART, ordered.PLACE)


def running_mean(df: DataFrame, key: str, order: str, value: str, block_rows: int = 65536) -> DataFrame:
    """Mean of the values so far, per key in order."""
    sums = ordered.running_sums(
        df, [key], F.floor(F.col(order) / block_rows), [order], {"__sum": F.col(value), "__n": F.lit(1).cast("bigint")}
    )
    return sums.withColumn("running_mean", F.col("__sum") / F.col("__n")).drop("__sum", "__n")


# -- token-level measures ----------------------------------------------------------------
def importance_ratio(old: Column, sampling: Column, cap: float = 2.0) -> Column:
    return F.zip_with(old, sampling, lambda a, b: F.least(F.exp(a - b), F.lit(cap)))


def importance_stats(df: DataFrame, old: str, sampling: str, mask: str, cap: float = 2.0) -> DataFrame:
    """Log-prob difference and ratio over unmasked tokens; zeros where there are none."""
    keep = lambda values: F.filter(zip_with_mask(values, F.col(mask)), lambda v: v.isNotNull())
    gap = keep(F.zip_with(old, sampling, lambda a, b: F.abs(a - b)))
    ratio = keep(importance_ratio(F.col(old), F.col(sampling), cap))
    rows = df.select(gap.alias("gap"), ratio.alias("ratio")).select(
        F.size("gap").alias("n"),
        array_sum(F.col("gap")).alias("gap_sum"),
        F.array_max("gap").alias("gap_max"),
        array_sum(F.col("ratio")).alias("ratio_sum"),
        F.array_min("ratio").alias("ratio_min"),
        F.array_max("ratio").alias("ratio_max"),
    )
    n = F.sum("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        zero(F.sum("gap_sum") / F.nullif(n, F.lit(0))).alias("mean_difference"),
        zero(F.max("gap_max")).alias("max_difference"),
        zero(F.min("ratio_min")).alias("min_ratio"),
        zero(F.sum("ratio_sum") / F.nullif(n, F.lit(0))).alias("mean_ratio"),
        zero(F.max("ratio_max")).alias("max_ratio"),
    )


def zip_with_mask(values: Column, mask: Column) -> Column:
    return F.zip_with(values, mask, lambda v, m: F.when(m != 0, v))


def log_ratio(logps: Column, old: Column, mask: Column, level: str = "token") -> Column:
    """Array of log importance weights; one entry per token or (``sequence``) the same mean for all."""
    tokens = F.zip_with(logps, old, lambda a, b: a - b)
    if level == "token":
        return tokens
    if level == "sequence":
        mean = masked_sum(tokens, mask) / F.greatest(mask_size(mask), F.lit(1))
        return A.let(mean, lambda m: F.transform(logps, lambda _: m))
    raise ValueError(f"unknown importance sampling level: {level}")


def clip_fractions(
    df: DataFrame, logps: str, old: str, mask: str, advantage: str, low: float = 0.2, high: float = 0.2, level: str = "token"
) -> DataFrame:
    """Share of tokens (or sequences) whose ratio is clipped below, above, or at all."""
    m, adv = F.col(mask), F.col(advantage)
    ratio = F.transform(log_ratio(F.col(logps), F.col(old), m, level), lambda x: F.exp(x))
    below = lambda r: (r < 1 - low) & (adv < 0)
    above = lambda r: (r > 1 + high) & (adv > 0)
    rows = df.select(ratio.alias("r"), m.alias("m"), adv.alias(advantage))
    if level == "sequence":
        first = F.get("r", F.lit(0))
        rows = rows.select(below(first).cast("int").alias("lo"), above(first).cast("int").alias("hi"), F.lit(1).alias("n"))
    else:
        count = lambda test: F.size(F.filter(zip_with_mask(F.col("r"), F.col("m")), lambda r: F.coalesce(test(r), F.lit(False))))
        rows = rows.select(count(below).alias("lo"), count(above).alias("hi"), mask_size(F.col("m")).alias("n"))
    n = F.greatest(F.sum("n"), F.lit(1))
    return rows.agg(
        (F.sum("lo") / n).alias("low"), (F.sum("hi") / n).alias("high"), (F.sum(F.col("lo") + F.col("hi")) / n).alias("region")
    )


def token_kl(logps: Column, ref: Column, kind: str = "k1") -> Column:
    """Per-token KL estimate: ``k1`` = log ratio, ``k3`` = exp(d) - d - 1 with d = ref - logp."""
    if kind == "k1":
        return F.zip_with(ref, logps, lambda r, p: -(r - p))
    if kind == "k3":
        return F.zip_with(ref, logps, lambda r, p: F.exp(r - p) - (r - p) - 1)
    raise ValueError(f"unknown estimator: {kind}")


def entropy_mask(df: DataFrame, entropy: str, mask: str, quantile: float, name: str = "entropy_mask") -> DataFrame:
    """Mark unmasked tokens whose entropy reaches the exact quantile over all of them."""
    tokens = df.select(F.explode(zip_with_mask(F.col(entropy), F.col(mask))).alias("e")).filter(F.col("e").isNotNull())
    bound = ordered.exact_quantile(tokens, "e", quantile)
    if bound is None:
        return df.withColumn(name, F.transform(F.col(mask), lambda m: F.lit(0)))
    marked = F.zip_with(entropy, mask, lambda e, m: ((m != 0) & (e >= F.lit(bound))).cast("int"))
    return df.withColumn(name, marked)


def clipped_loss(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, delta: float | None = None) -> Column:
    """Clipped surrogate of one ratio: a token's, a whole sequence's or an image step's."""
    bounded = clamp(ratio, 1 - low, 1 + high)
    used = ratio if delta is None else clamp(ratio, high=delta)
    return -F.least(used * advantage, bounded * advantage)


def surrogate_rows(
    df: DataFrame,
    logps: str,
    old: str,
    mask: str,
    advantage: str,
    ref: str | None = None,
    beta: float = 0.001,
    low: float = 0.2,
    high: float = 0.2,
    delta: float | None = None,
    level: str = "token",
    keep: str | None = None,
    weights: str | None = None,
) -> DataFrame:
    """Add ``token_loss`` (array): clipped surrogate, optionally kept to the tokens of ``keep``,
    weighted by ``weights`` and with ``beta`` times the k3 KL to ``ref``."""
    adv = F.col(advantage)
    loss = F.transform(
        log_ratio(F.col(logps), F.col(old), F.col(mask), level), lambda x: clipped_loss(F.exp(x), adv, low, high, delta)
    )
    if keep is not None:
        loss = masked(loss, F.col(keep))
    if weights is not None:
        loss = F.zip_with(loss, weights, lambda x, w: x * w)
    if ref is not None and beta != 0.0:
        loss = F.zip_with(loss, token_kl(F.col(logps), F.col(ref), "k3"), lambda x, k: x + beta * k)
    return df.withColumn("token_loss", loss)


def surrogate_loss(rows: DataFrame, mask: str, max_length: int, normalizer: float | None = None) -> DataFrame:
    """The four reductions of ``token_loss`` in one aggregation."""
    m = F.col(mask)
    per_row = rows.select(masked_sum(F.col("token_loss"), m).alias("s"), mask_size(m).alias("n"))
    total, tokens = F.sum("s"), F.greatest(F.sum("n"), F.lit(1))
    return per_row.agg(
        F.avg(F.col("s") / F.greatest(F.col("n"), F.lit(1))).alias("grpo"),
        (total / tokens).alias("bnpo"),
        (total / (F.count(F.lit(1)) * max_length)).alias("dr_grpo"),
        (total / (tokens if normalizer is None else F.lit(float(normalizer)))).alias("dapo"),
    )


def token_rewards(logps: Column, ref: Column, length: Column, score: Column, coef: float = 0.05, kind: str = "k1") -> Column:
    """``-coef`` * KL per token, plus the score at index ``length`` (the last one where that is outside)."""
    kl = token_kl(logps, ref, kind)
    end = F.when(length < F.size(logps), length).otherwise(length - 1)
    return A.let(end, lambda at: F.transform(kl, lambda k, i: -coef * k + F.when(i == at, score).otherwise(F.lit(0.0))))


def whiten(df: DataFrame, values: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """Scale ``values`` to unit variance over all unmasked tokens of the table; others become 0.

    The variance is the sample variance, taken around the mean in a second pass.
    """
    v, m = F.col(values), F.col(mask)
    sums = df.select(masked_sum(v, m).alias("s"), mask_size(m).alias("n"))
    mean = sums.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    around = df.withColumn("__mean", mean).select(
        F.aggregate(zip_with_mask(v, m), F.lit(0.0), lambda a, x: a + F.coalesce(F.pow(x - F.col("__mean"), F.lit(2.0)), F.lit(0.0))).alias("s"),
        mask_size(m).alias("n"),
    )
    variance = around.agg((F.sum("s") / (F.sum("n") - 1)).alias("v")).scalar()
    rows = df.withColumn("__mean", mean).withColumn("__scale", 1 / F.sqrt(variance + 1e-8))
    back = F.lit(0.0) if shift_mean else F.col("__mean")
    scaled = F.zip_with(v, m, lambda x, k: F.when(k != 0, (x - F.col("__mean")) * F.col("__scale") + back).otherwise(F.lit(0.0)))
    return rows.withColumn(values, scaled).drop("__mean", "__scale")


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantage estimates, by a fold from the last token to the first."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    none = F.array().cast("array<double>")
    zero = F.lit(0.0)

    def step(acc, x):
        now = x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["last"]
        return F.struct(x["v"].alias("next"), now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    start = F.struct(zero.alias("next"), zero.alias("last"), none.alias("out"))
    return F.aggregate(steps, start, step, lambda acc: F.reverse(acc["out"]))


def rollout_stats(df: DataFrame, logps: str, ref: str, score: str, ids: str | None = None, eos: int = 0, coef: float = 0.05, kind: str = "k1") -> DataFrame:
    """KL, entropy, rewards and EOS counts over a rollout."""
    kl = token_kl(F.col(logps), F.col(ref), kind)
    rows = df.select(
        array_sum(kl).alias("kl"),
        (-array_sum(F.col(logps))).alias("entropy"),
        F.col(score).alias("score"),
        (F.size(F.filter(F.col(ids), lambda x: x == eos)) if ids else F.lit(0)).alias("eos"),
    )
    penalty = -coef * F.col("kl")
    return rows.agg(
        F.avg("kl").alias("kl"),
        F.avg("entropy").alias("entropy"),
        F.avg(penalty).alias("non_score_reward"),
        (F.avg(penalty) + F.avg("score")).alias("rlhf_reward"),
        F.avg("score").alias("scores"),
        F.sum("eos").alias("num_eos_tokens"),
    )


def pair_by_reward(df: DataFrame, prompt: str, order: str, reward: str, completion: str) -> DataFrame:
    """Best and worst completion per prompt; of equal ones the first is chosen."""
    rank = F.struct(F.col(reward), -F.col(order))
    pick = lambda f, name: f(F.struct(order, reward, completion), rank).alias(name)
    best = df.groupBy(prompt).agg(pick(F.max_by, "c"), pick(F.min_by, "r"), F.count(F.lit(1)).alias("n"))
    return best.filter(F.col("n") > 1).select(
        prompt,
        F.col("c")[completion].alias("chosen"),
        F.col("r")[completion].alias("rejected"),
        (F.col("c")[reward] - F.col("r")[reward]).alias("margin"),
    )


def pair_by_rank(df: DataFrame, first: str, second: str, rank: str) -> DataFrame:
    """Chosen and rejected from a judge's rank of the first completion (0 = best)."""
    wins = F.col(rank) == 0
    return df.withColumn("chosen", F.when(wins, F.col(first)).otherwise(F.col(second))).withColumn(
        "rejected", F.when(wins, F.col(second)).otherwise(F.col(first))
    )
