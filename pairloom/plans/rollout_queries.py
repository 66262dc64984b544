"""Rewards, advantages and rollout statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.mathx import array_sum
from pairloom.operators import rollouts as R
from pairloom.plans.registry import q6, query, r6

SUM = "coalesce(r1 * 1.0, 0) + coalesce(r2 * 0.3183098861837907::DOUBLE, 0)"
REWARDED = f"rewarded AS (SELECT *, {SUM} AS reward FROM scored)"


def scored(t):
    return t.scored().withColumn("reward", R.reward_sum(["r1", "r2"], [1.0, 0.3183098861837907]))


def rounded(df, keep, values):
    return df.select(*keep, *[r6(F.col(v)).alias(v) for v in values])


def series(array: str) -> str:
    return f"array_to_string(list_transform({array}, lambda x: round(x * 1000000)::BIGINT), ',')"


def shown(array):
    whole = F.transform(array, lambda x: F.round(x * 1000000, 0).cast("bigint"))
    return F.array_join(whole.cast("array<string>"), ",")


@query(
    "reward_columns",
    """SELECT gen_no, r1 / 10 AS short, r2 AS long, r1 IS NULL AND r2 IS NULL AS unscored FROM scored""",
    ("scored",),
)
def _(t):
    rows = R.with_rewards(t.scored(), {"short": F.col("r1") / 10, "long": F.coalesce("r2", F.lit(float("nan")))})
    return rows.select("gen_no", "short", "long", "unscored")


@query("reward_sum", f"WITH {REWARDED} SELECT gen_no, {q6('reward')} AS reward FROM rewarded", ("scored",))
def _(t):
    return rounded(scored(t), ["gen_no"], ["reward"])


def group_query(name: str, scale: str, spread: str):
    over = "OVER (PARTITION BY prompt_id)"
    centred = f"(reward - avg(reward) {over})"
    scaled = centred if scale == "none" else f"{centred} / ({spread} + 1e-4)"

    @query(
        name,
        f"WITH {REWARDED} SELECT gen_no, {q6(scaled)} AS advantage, abs({spread}) <= 1e-8 AS zero_std FROM rewarded",
        ("scored",),
    )
    def _(t):
        out = R.group_advantages(scored(t), "prompt_id", scale=scale)
        return out.select("gen_no", r6(F.col("advantage")).alias("advantage"), "zero_std")


group_query("adv_group", "group", "stddev_samp(reward) OVER (PARTITION BY prompt_id)")
group_query("adv_group_batch", "batch", "(SELECT stddev_samp(reward) FROM rewarded)")
group_query("adv_group_none", "none", "stddev_samp(reward) OVER (PARTITION BY prompt_id)")

LOO = f"""{REWARDED}, c AS (SELECT *, greatest(least(reward, 60), 5) - 0.05::DOUBLE * kl AS r FROM rewarded),
    a AS (SELECT gen_no, r - (sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0) AS advantage FROM c WINDOW w AS (PARTITION BY prompt_id))"""


@query("adv_rloo", f"WITH {LOO} SELECT gen_no, {q6('advantage')} AS advantage FROM a", ("scored",))
def _(t):
    out = R.leave_one_out_advantages(scored(t), "prompt_id", clip=(5.0, 60.0), kl="kl", beta=0.05)
    return rounded(out, ["gen_no"], ["advantage"])


@query(
    "adv_rloo_normalized",
    f"""WITH {LOO} SELECT gen_no, {q6('(advantage - (SELECT avg(advantage) FROM a)) / ((SELECT stddev_samp(advantage) FROM a) + 1e-4)')} AS advantage FROM a""",
    ("scored",),
)
def _(t):
    out = R.leave_one_out_advantages(scored(t), "prompt_id", clip=(5.0, 60.0), kl="kl", beta=0.05, normalize=True)
    return rounded(out, ["gen_no"], ["advantage"])


@query(
    "adv_zscore",
    f"""WITH {REWARDED} SELECT gen_no, {q6('(reward - (SELECT avg(reward) FROM rewarded)) / ((SELECT stddev_pop(reward) FROM rewarded) + 1e-8)')} AS advantage FROM rewarded""",
    ("scored",),
)
def _(t):
    return rounded(R.zscore_advantages(scored(t)), ["gen_no"], ["advantage"])


@query(
    "adv_zscore_prompt",
    f"""WITH {REWARDED} SELECT gen_no, {q6('(reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8)')} AS advantage
        FROM rewarded WINDOW w AS (PARTITION BY prompt_id)""",
    ("scored",),
)
def _(t):
    return rounded(R.zscore_advantages(scored(t), group="prompt_id"), ["gen_no"], ["advantage"])


@query(
    "eos_penalty",
    f"WITH {REWARDED} SELECT gen_no, {q6('CASE WHEN list_contains(ids, 0) THEN reward ELSE reward - 1 END')} AS reward FROM rewarded",
    ("scored",),
)
def _(t):
    return scored(t).select("gen_no", r6(R.eos_penalty(F.col("reward"), F.col("ids"), 0, 1.0)).alias("reward"))


@query(
    "length_stats",
    f"""SELECT {q6('avg(len(ids))')} AS mean_length, min(len(ids)) AS min_length, max(len(ids)) AS max_length,
          {q6('1 - count(*) FILTER (WHERE terminated) / count(*)')} AS clipped_ratio,
          {q6('coalesce(avg(len(ids)) FILTER (WHERE terminated), 0)')} AS mean_terminated_length,
          coalesce(min(len(ids)) FILTER (WHERE terminated), 0) AS min_terminated_length,
          coalesce(max(len(ids)) FILTER (WHERE terminated), 0) AS max_terminated_length FROM scored""",
    ("scored",),
)
def _(t):
    out = R.length_stats(t.scored(), F.size("ids"), F.col("terminated"))
    whole = ["min_length", "max_length", "min_terminated_length", "max_terminated_length"]
    return rounded(out, whole, ["mean_length", "clipped_ratio", "mean_terminated_length"])


@query(
    "reward_stats",
    f"""SELECT 'r1' AS func, {q6('avg(r1)')} AS mean, {q6('stddev_samp(r1)')} AS std FROM scored
        UNION ALL SELECT 'r2', {q6('avg(r2)')}, {q6('stddev_samp(r2)')} FROM scored""",
    ("scored",),
)
def _(t):
    return rounded(R.reward_stats(t.scored(), ["r1", "r2"]), ["func"], ["mean", "std"])


@query(
    "group_reward_stats",
    f"""WITH {REWARDED}, s AS (SELECT avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS s FROM rewarded WINDOW w AS (PARTITION BY prompt_id))
        SELECT {q6('avg(m)')} AS reward, {q6('avg(s)')} AS reward_std,
          {q6('avg(CASE WHEN abs(s) <= 1e-8 THEN 1 ELSE 0 END)')} AS frac_reward_zero_std FROM s""",
    ("scored",),
)
def _(t):
    return rounded(R.group_reward_stats(scored(t), "prompt_id"), [], ["reward", "reward_std", "frac_reward_zero_std"])


UNMASKED = """x AS (SELECT row_id, unnest(logps) AS p, unnest(old) AS o, unnest(ref) AS f, unnest(mask) AS m, unnest(entropy) AS e, advantage FROM token_logps),
    u AS (SELECT * FROM x WHERE m <> 0)"""


@query(
    "importance_stats",
    f"""WITH {UNMASKED} SELECT {q6('avg(abs(p - o))')} AS mean_difference, {q6('max(abs(p - o))')} AS max_difference,
          {q6('min(least(exp(p - o), 1.2::DOUBLE))')} AS min_ratio, {q6('avg(least(exp(p - o), 1.2::DOUBLE))')} AS mean_ratio,
          {q6('max(least(exp(p - o), 1.2::DOUBLE))')} AS max_ratio FROM u""",
    ("token_logps",),
)
def _(t):
    out = R.importance_stats(t.token_logps(), "logps", "old", "mask", cap=1.2)
    return rounded(out, [], out.columns)


@query(
    "clip_fractions",
    f"""WITH {UNMASKED}, r AS (SELECT exp(p - o) < 0.8::DOUBLE AND advantage < 0 AS lo, exp(p - o) > 1.2::DOUBLE AND advantage > 0 AS hi FROM u)
        SELECT {q6('avg(lo::INT)')} AS low, {q6('avg(hi::INT)')} AS high, {q6('avg((lo OR hi)::INT)')} AS region FROM r""",
    ("token_logps",),
)
def _(t):
    out = R.clip_fractions(t.token_logps(), "logps", "old", "mask", "advantage")
    return rounded(out, [], out.columns)


SEQUENCE = f"""{UNMASKED}, q AS (SELECT row_id, any_value(advantage) AS advantage, exp(avg(p - o)) AS r FROM u GROUP BY row_id)"""


@query(
    "clip_fractions_sequence",
    f"""WITH {SEQUENCE}, r AS (SELECT r < 0.9::DOUBLE AND advantage < 0 AS lo, r > 1.1::DOUBLE AND advantage > 0 AS hi FROM q)
        SELECT {q6('avg(lo::INT)')} AS low, {q6('avg(hi::INT)')} AS high, {q6('avg((lo OR hi)::INT)')} AS region FROM r""",
    ("token_logps",),
)
def _(t):
    out = R.clip_fractions(t.token_logps(), "logps", "old", "mask", "advantage", 0.1, 0.1, level="sequence")
    return rounded(out, [], out.columns)


@query(
    "kl_estimators",
    f"""WITH {UNMASKED} SELECT row_id, {q6('sum(p - f)')} AS k1, {q6('sum(exp(f - p) - (f - p) - 1)')} AS k3,
          {q6('avg(exp(f - p) - (f - p) - 1)')} AS mean_k3 FROM u GROUP BY row_id""",
    ("token_logps",),
)
def _(t):
    from pairloom.functions.mathx import mask_size, masked_sum

    k1, k3 = R.token_kl(F.col("logps"), F.col("ref"), "k1"), R.token_kl(F.col("logps"), F.col("ref"), "k3")
    rows = t.token_logps().select("row_id", "mask", k1.alias("k1"), k3.alias("k3"))
    rows = rows.select(
        "row_id",
        masked_sum(F.col("k1"), F.col("mask")).alias("k1"),
        masked_sum(F.col("k3"), F.col("mask")).alias("k3"),
        (masked_sum(F.col("k3"), F.col("mask")) / mask_size(F.col("mask"))).alias("mean_k3"),
    )
    # rows without an unmasked token have no estimate
    return rounded(rows.filter(F.col("mean_k3").isNotNull()), ["row_id"], ["k1", "k3", "mean_k3"])


@query(
    "entropy_mask",
    f"""WITH {UNMASKED}, b AS (SELECT quantile_cont(e, 0.8) AS bound FROM u)
        SELECT row_id, array_to_string(list_transform(list_zip(entropy, mask), lambda z: CASE WHEN z[2] <> 0 AND z[1] >= bound THEN 1 ELSE 0 END), ',') AS marked
        FROM token_logps, b""",
    ("token_logps",),
)
def _(t):
    out = R.entropy_mask(t.token_logps().select("row_id", "entropy", "mask"), "entropy", "mask", 0.8)
    return out.select("row_id", F.array_join(F.col("entropy_mask").cast("array<string>"), ",").alias("marked"))


def surrogate_sql(source: str, ratio: str, loss: str = "0") -> str:
    clipped = f"-least(least({ratio}, 1.5::DOUBLE) * advantage, greatest(least({ratio}, 1.2::DOUBLE), 0.8::DOUBLE) * advantage)"
    return f"""WITH {source}, l AS (SELECT row_id, {clipped} + 0.001::DOUBLE * (exp(f - p) - (f - p) - 1) AS loss FROM t),
        r AS (SELECT row_id, sum(loss) AS s, count(*) AS n FROM l GROUP BY row_id),
        z AS (SELECT row_id, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM token_logps LEFT JOIN r USING (row_id))
        SELECT {q6('avg(s / greatest(n, 1))')} AS grpo, {q6('sum(s) / sum(n)')} AS bnpo, {q6('sum(s) / (count(*) * 256)')} AS dr_grpo,
          {q6('sum(s) / sum(n)')} AS dapo FROM z"""


@query("surrogate_loss", surrogate_sql(f"{UNMASKED}, t AS (SELECT * FROM u)", "exp(p - o)"), ("token_logps",))
def _(t):
    rows = R.surrogate_rows(t.token_logps(), "logps", "old", "mask", "advantage", ref="ref", delta=1.5)
    out = R.surrogate_loss(rows, "mask", 256)
    return rounded(out, [], out.columns)


@query(
    "surrogate_loss_sequence",
    surrogate_sql(f"{SEQUENCE}, t AS (SELECT u.*, q.r FROM u JOIN q USING (row_id))", "r"),
    ("token_logps",),
)
def _(t):
    rows = R.surrogate_rows(t.token_logps(), "logps", "old", "mask", "advantage", ref="ref", delta=1.5, level="sequence")
    out = R.surrogate_loss(rows, "mask", 256)
    return rounded(out, [], out.columns)


@query(
    "sequence_clipped_loss",
    f"""WITH q AS (SELECT row_id, advantage, exp(list_sum(logps) - list_sum(old)) AS r FROM token_logps)
        SELECT row_id, {q6('-least(r * advantage, greatest(least(r, 1.2::DOUBLE), 0.8::DOUBLE) * advantage)')} AS loss FROM q""",
    ("token_logps",),
)
def _(t):
    ratio = F.exp(array_sum(F.col("logps")) - array_sum(F.col("old")))
    return t.token_logps().select("row_id", r6(R.clipped_loss(ratio, F.col("advantage"))).alias("loss"))


TOKEN_REWARDS = """list_transform(list_zip(logps, ref), lambda z, i: -0.05::DOUBLE * (z[1] - z[2]) +
          CASE WHEN i - 1 = CASE WHEN row_id % 8 < len(logps) THEN row_id % 8 ELSE row_id % 8 - 1 END THEN score ELSE 0 END)"""


def token_rewards(t):
    value = R.token_rewards(F.col("logps"), F.col("ref"), F.col("row_id") % 8, F.col("score"))
    return t.token_logps().withColumn("rewards", value)


@query("token_rewards", f"SELECT row_id, {series(TOKEN_REWARDS)} AS rewards FROM token_logps", ("token_logps",))
def _(t):
    return token_rewards(t).select("row_id", shown(F.col("rewards")).alias("rewards"))


WHITE = f"""a AS (SELECT row_id, mask, {TOKEN_REWARDS} AS v FROM token_logps),
       s AS (SELECT avg(x) AS m, var_samp(x) AS v2 FROM (SELECT unnest(v) AS x, unnest(mask) AS k FROM a) WHERE k <> 0)"""


@query(
    "token_rewards_whitened",
    f"""WITH {WHITE} SELECT row_id, {series('list_transform(list_zip(v, mask), lambda z: CASE WHEN z[2] <> 0 THEN (z[1] - m) / sqrt(v2 + 1e-8) + m ELSE 0 END)')} AS rewards FROM a, s""",
    ("token_logps",),
)
def _(t):
    out = R.whiten(token_rewards(t), "rewards", "mask", shift_mean=False)
    return out.select("row_id", shown(F.col("rewards")).alias("rewards"))


GAE = """WITH a AS (SELECT row_id, list_transform(logps, lambda x: x / 3) AS r, "values" AS v, len(logps) AS n FROM token_logps),
       d AS (SELECT row_id, v, n, list_transform(range(1, n + 1), lambda i: r[i] + 0.99::DOUBLE * coalesce(v[i + 1], 0) - v[i]) AS d FROM a),
       g AS (SELECT row_id, v, list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(i, n + 1), lambda j: d[j] * pow(0.99::DOUBLE * 0.95::DOUBLE, j - i)))) AS adv FROM d)"""


@query(
    "gae",
    f"{GAE} SELECT row_id, {series('adv')} AS advantages, {series('list_transform(list_zip(adv, v), lambda z: z[1] + z[2])')} AS returns FROM g",
    ("token_logps",),
)
def _(t):
    adv = R.gae(F.transform("logps", lambda x: x / 3), F.col("values"), 0.99, 0.95)
    rows = t.token_logps().select("row_id", "values", adv.alias("adv"))
    returns = F.zip_with("adv", "values", lambda a, v: a + v)
    return rows.select("row_id", shown(F.col("adv")).alias("advantages"), shown(returns).alias("returns"))


@query(
    "rollout_stats",
    f"""WITH a AS (SELECT list_sum(logps) - list_sum(ref) AS kl, -list_sum(logps) AS entropy, score,
              len(list_filter(mask, lambda x: x = 0)) AS eos FROM token_logps)
        SELECT {q6('avg(kl)')} AS kl, {q6('avg(entropy)')} AS entropy, {q6('avg(-0.05::DOUBLE * kl)')} AS non_score_reward,
          {q6('avg(-0.05::DOUBLE * kl) + avg(score)')} AS rlhf_reward, {q6('avg(score)')} AS scores, sum(eos)::BIGINT AS num_eos_tokens FROM a""",
    ("token_logps",),
)
def _(t):
    out = R.rollout_stats(t.token_logps(), "logps", "ref", "score", ids="mask", eos=0)
    return rounded(out, ["num_eos_tokens"], ["kl", "entropy", "non_score_reward", "rlhf_reward", "scores"])


PAIRED = f"{REWARDED}, p AS (SELECT gen_no // 2 AS prompt, gen_no, reward, 'c' || gen_no AS completion FROM rewarded)"


@query(
    "pair_by_reward",
    f"""WITH {PAIRED} SELECT a.prompt, CASE WHEN a.reward >= b.reward THEN a.completion ELSE b.completion END AS chosen,
          CASE WHEN a.reward >= b.reward THEN b.completion ELSE a.completion END AS rejected, {q6('abs(a.reward - b.reward)')} AS margin
        FROM p a JOIN p b ON a.prompt = b.prompt AND a.gen_no + 1 = b.gen_no""",
    ("scored",),
)
def _(t):
    rows = scored(t).select(
        F.floor(F.col("gen_no") / 2).cast("bigint").alias("prompt"), "gen_no", "reward",
        F.concat(F.lit("c"), F.col("gen_no").cast("string")).alias("completion"),
    )
    out = R.pair_by_reward(rows, "prompt", "gen_no", "reward", "completion")
    return rounded(out, ["prompt", "chosen", "rejected"], ["margin"])


@query(
    "pair_by_rank",
    """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN chosen ELSE rejected END AS chosen, CASE WHEN row_id % 3 = 0 THEN rejected ELSE chosen END AS rejected FROM preferences""",
    ("preferences",),
)
def _(t):
    rows = t.preferences().select("row_id", F.col("chosen").alias("first"), F.col("rejected").alias("second"), (F.col("row_id") % 3).alias("rank"))
    return R.pair_by_rank(rows, "first", "second", "rank").select("row_id", "chosen", "rejected")


TABLE = f"""{REWARDED}, v AS (SELECT gen_no, 'p' || prompt_id AS prompt, (gen_no // 100)::VARCHAR AS step, 'c' || gen_no AS completion, r1, r2,
              reward - avg(reward) OVER (PARTITION BY prompt_id) AS advantage FROM rewarded)"""


def logged(t):
    rows = R.group_advantages(scored(t), "prompt_id", scale="none")
    return rows.select(
        "gen_no",
        F.concat(F.lit("p"), F.col("prompt_id").cast("string")).alias("prompt"),
        F.floor(F.col("gen_no") / 100).cast("bigint").alias("step"),
        F.concat(F.lit("c"), F.col("gen_no").cast("string")).alias("completion"),
        "r1", "r2", r6(F.col("advantage")).alias("advantage"),
    )


@query("completions_table", f"WITH {TABLE} SELECT prompt, step, completion, r1, r2, {q6('advantage')} AS advantage FROM v", ("scored",))
def _(t):
    return R.completions_table(logged(t), "step", ["r1", "r2"])


@query(
    "completions_unique",
    f"""WITH {TABLE} SELECT prompt, step, completion, r1, r2, {q6('advantage')} AS advantage FROM v
        QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY gen_no) = 1""",
    ("scored",),
)
def _(t):
    return R.completions_table(logged(t), "step", ["r1", "r2"], unique=True)


@query(
    "tokens_seen",
    """SELECT step, sum(n)::BIGINT AS num_tokens, (sum(sum(n)) OVER (ORDER BY step))::BIGINT AS num_tokens_seen
       FROM (SELECT gen_no // 8 AS step, len(ids) AS n FROM scored) GROUP BY step""",
    ("scored",),
)
def _(t):
    rows = t.scored().select(F.floor(F.col("gen_no") / 8).cast("bigint").alias("step"), "ids")
    return R.tokens_seen(rows, "step", F.size("ids"))


@query(
    "running_mean",
    f"""SELECT user_id, event_id, {q6('avg(value / 3.14159::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id)')} AS running_mean FROM events""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", (F.col("value") / 3.14159).alias("value"))
    out = R.running_mean(rows, "user_id", "event_id", "value")
    return rounded(out, ["user_id", "event_id"], ["running_mean"])
