"""Preference scoring and metric reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import losses as L
from pairloom.operators import metrics as M
from pairloom.operators import preferences as P
from pairloom.functions.mathx import clamp
from pairloom.plans.registry import q6, query, r6


def rounded(df, keep, values):
    return df.select(*keep, *[r6(F.col(v)).alias(v) for v in values])


def ls(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"


def sg(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def masked(values: str, mask: str = "mask") -> str:
    return f"list_sum(list_transform(list_zip({values}, {mask}), lambda z: CASE WHEN z[2] <> 0 THEN z[1] ELSE 0 END))"


@query(
    "seq_logp",
    f"SELECT row_id, {q6(masked('logps'))} AS total, {q6(masked('logps') + ' / nullif(list_sum(mask), 0)')} AS mean FROM token_logps",
    ("token_logps",),
)
def _(t):
    v, m = F.col("logps"), F.col("mask")
    from pairloom.functions.mathx import mask_size

    total = P.sequence_logp(v, m)
    return t.token_logps().select(
        "row_id", r6(total).alias("total"), r6(total / F.nullif(mask_size(m), F.lit(0))).alias("mean")
    )


@query(
    "ld_logp",
    f"""WITH a AS (SELECT row_id, list_transform(list_zip(logps, mask), lambda z, i: CASE WHEN i > list_sum(mask) THEN 0 WHEN i <= row_id % 5 THEN z[1] ELSE 0.5::DOUBLE * z[1] END) AS w FROM token_logps)
        SELECT row_id, {q6('list_sum(w)')} AS logp FROM a""",
    ("token_logps",),
)
def _(t):
    shared = (F.col("row_id") % 5).cast("int")
    return t.token_logps().select(
        "row_id", r6(P.desensitised_logp(F.col("logps"), F.col("mask"), shared, 0.5)).alias("logp")
    )


@query(
    "wpo_weight",
    f"""SELECT row_id, {q6(f"least(exp(list_sum(logps) / len(logps) + list_sum(old) / len(old) + 0.6::DOUBLE), 1)")} AS weight FROM token_logps""",
    ("token_logps",),
)
def _(t):
    ones = F.transform("logps", lambda x: F.lit(1))
    adjusted = F.transform("logps", lambda x: x + 0.6)
    return t.token_logps().select("row_id", r6(P.policy_weight(adjusted, ones, F.col("old"), ones)).alias("weight"))


PAIR = """a AS (SELECT *, chosen_logps - ref_chosen_logps AS u, rejected_logps - ref_rejected_logps AS d FROM pair_logps),
       b AS (SELECT *, u - d AS z, (SELECT (avg(0.1::DOUBLE * u) + avg(0.1::DOUBLE * d)) / 2 FROM a) AS delta,
               (SELECT -avg(chosen_logps) FROM a) AS nll FROM a)"""
B = "0.1::DOUBLE"
LOSS_SQL = {
    "sigmoid": f"-{ls(f'{B} * z')} * 0.9::DOUBLE - {ls(f'-{B} * z')} * 0.1::DOUBLE",
    "robust": f"(-{ls(f'{B} * z')} * 0.9::DOUBLE + {ls(f'-{B} * z')} * 0.1::DOUBLE) / 0.8::DOUBLE",
    "exo_pair": f"{sg(f'{B} * z')} * ({ls(f'{B} * z')} - ln(0.9::DOUBLE)) + {sg(f'-{B} * z')} * ({ls(f'-{B} * z')} - ln(0.1::DOUBLE))",
    "hinge": f"greatest(1 - {B} * z, 0)",
    "ipo": f"pow(z - 5, 2)",
    "bco_pair": f"-{ls(f'{B} * u - delta')} - {ls(f'-({B} * d - delta)')}",
    "sppo_hard": "pow(u - 5, 2) + pow(d + 5, 2)",
    "nca_pair": f"-{ls(f'{B} * u')} - 0.5::DOUBLE * {ls(f'-{B} * u')} - 0.5::DOUBLE * {ls(f'-{B} * d')}",
    "apo_zero": f"1 - {sg(f'{B} * u')} + {sg(f'{B} * d')}",
    "apo_down": f"{sg(f'{B} * u')} + 1 - {sg(f'{B} * (u - d)')}",
    "discopop": f"-{ls(f'{B} * z')} * (1 - {sg(f'{B} * z / 0.05::DOUBLE')}) + exp(-{B} * z) * {sg(f'{B} * z / 0.05::DOUBLE')}",
    "sft": "nll",
}


def nll(t):
    return t.pair_logps().agg((-F.avg("chosen_logps")).alias("n")).scalar()


@query(
    "dpo_losses",
    f"WITH {PAIR} SELECT row_id, " + ", ".join(f"{q6(e)} AS loss_{k}" for k, e in LOSS_SQL.items()) + " FROM b",
    ("pair_logps",),
)
def _(t):
    out = P.with_losses(t.pair_logps(), list(L.PAIR_LOSSES), smoothing=0.1, nll=nll(t))
    return rounded(out, ["row_id"], ["loss_" + k for k in L.PAIR_LOSSES])


def sorted_query(name, kind, left, right):
    @query(
        name,
        f"""WITH {PAIR}, x AS (SELECT row_number() OVER (ORDER BY {left}) - 1 AS rank, {left} AS l FROM a),
            y AS (SELECT row_number() OVER (ORDER BY {right}) - 1 AS rank, {right} AS r FROM a)
            SELECT rank, {q6('l - r')} AS delta, {q6(f"-{ls(f'{B} * (l - r)')} * 0.9::DOUBLE - {ls(f'-{B} * (l - r)')} * 0.1::DOUBLE")} AS loss FROM x JOIN y USING (rank)""",
        ("pair_logps",),
    )
    def _(t):
        return rounded(P.sorted_loss(t.pair_logps(), kind, smoothing=0.1), ["rank"], ["delta", "loss"])


sorted_query("dpo_aot_pair", "aot_pair", "chosen_logps - ref_chosen_logps", "rejected_logps - ref_rejected_logps")
sorted_query("dpo_aot", "aot", "chosen_logps - rejected_logps", "ref_chosen_logps - ref_rejected_logps")


@query(
    "f_divergence",
    f"""WITH {PAIR} SELECT row_id, {q6('z')} AS reverse_kl, {q6('(exp(-0.5::DOUBLE * d) - exp(-0.5::DOUBLE * u)) / 0.5::DOUBLE')} AS alpha,
          {q6('z - (ln(1 + exp(u)) - ln(1 + exp(d)))')} AS js, {q6(f"-{ls(f'{B} * (z - (ln(1 + exp(u)) - ln(1 + exp(d))))')}")} AS loss_js,
          {q6('chosen_logps - rejected_logps')} AS reference_free FROM b""",
    ("pair_logps",),
)
def _(t):
    pair, free = P.pair_of(), P.pair_of(reference_free=True)
    rows = P.with_losses(t.pair_logps(), ["sigmoid"], divergence="js")
    return rows.select(
        "row_id",
        r6(pair.logits()).alias("reverse_kl"),
        r6(pair.logits("alpha", 0.5)).alias("alpha"),
        r6(pair.logits("js")).alias("js"),
        r6(F.col("loss_sigmoid")).alias("loss_js"),
        r6(free.logits()).alias("reference_free"),
    )


MIX = f"""(({ls(f'{B} * z')}) * -0.8::DOUBLE + ({LOSS_SQL['bco_pair']}) * 0.2::DOUBLE + nll * 1 + 0.3::DOUBLE * nll)"""


@query(
    "loss_mix",
    f"""WITH {PAIR} SELECT row_id, {q6(MIX)} AS loss, {q6(f'{B} * u * 2')} AS chosen_reward, {q6(f'{B} * d * 2')} AS rejected_reward FROM b""",
    ("pair_logps",),
)
def _(t):
    weights = {"sigmoid": 0.8, "bco_pair": 0.2, "sft": 1.0}
    out = P.mixed_loss(t.pair_logps(), weights, rpo_alpha=0.3, nll=nll(t))
    return rounded(out, ["row_id"], ["loss", "chosen_reward", "rejected_reward"])


def ranked_sql(kind: str, left: str, right: str) -> str:
    """Loss of the i-th smallest left against the i-th smallest right value, by i."""
    return f"""{kind} AS (SELECT rank, -{ls(f'{B} * (l - r)')} AS {kind}_loss
        FROM (SELECT row_number() OVER (ORDER BY {left}) AS rank, {left} AS l FROM a) JOIN (SELECT row_number() OVER (ORDER BY {right}) AS rank, {right} AS r FROM a) USING (rank))"""


MIX_SORTED = f"""((-{ls(f'{B} * z')}) * 0.5::DOUBLE + aot_loss * 0.3::DOUBLE + aot_pair_loss * 0.2::DOUBLE + 0.3::DOUBLE * nll)
  * least(1, exp((chosen_logps + rejected_logps) / 4))"""


@query(
    "loss_mix_sorted",
    f"""WITH {PAIR}, {ranked_sql('aot', 'chosen_logps - rejected_logps', 'ref_chosen_logps - ref_rejected_logps')},
          {ranked_sql('aot_pair', 'chosen_logps - ref_chosen_logps', 'rejected_logps - ref_rejected_logps')},
          n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS rank FROM b)
        SELECT row_id, {q6(MIX_SORTED)} AS loss, {q6(f'{B} * u')} AS chosen_reward, {q6(f'{B} * d')} AS rejected_reward
        FROM n JOIN aot USING (rank) JOIN aot_pair USING (rank)""",
    ("pair_logps",),
)
def _(t):
    weights = {"sigmoid": 0.5, "aot": 0.3, "aot_pair": 0.2}
    policy = clamp(F.exp((F.col("chosen_logps") + F.col("rejected_logps")) / 4), high=1.0)
    out = P.mixed_loss(t.pair_logps(), weights, rpo_alpha=0.3, nll=nll(t), row_weight=policy, key="row_id")
    return rounded(out, ["row_id"], ["loss", "chosen_reward", "rejected_reward"])


REPORT = ["rewards_chosen", "rewards_rejected", "rewards_accuracies", "rewards_margins", "logps_chosen", "logps_rejected"]


@query(
    "preference_report",
    f"""WITH {PAIR} SELECT label, {q6(f'avg({B} * u)')} AS rewards_chosen, {q6(f'avg({B} * d)')} AS rewards_rejected,
          {q6('avg((u > d)::INT)')} AS rewards_accuracies, {q6(f'avg({B} * u - {B} * d)')} AS rewards_margins,
          {q6('avg(chosen_logps)')} AS logps_chosen, {q6('avg(rejected_logps)')} AS logps_rejected FROM b GROUP BY label""",
    ("pair_logps",),
)
def _(t):
    out = P.preference_report(P.with_losses(t.pair_logps(), ["sigmoid"]), by=["label"])
    return rounded(out, ["label"], REPORT)


UNPAIRED = """a AS (SELECT row_id, label, (chosen_logps - ref_chosen_logps) / 3.14159::DOUBLE AS u,
         (SELECT greatest(avg(rejected_logps - ref_rejected_logps) + 0.2::DOUBLE, 0) FROM pair_logps) AS kl FROM pair_logps)"""


def unpaired(t):
    ratio = (F.col("chosen_logps") - F.col("ref_chosen_logps")) / 3.14159
    return t.pair_logps().select("row_id", "label", ratio.alias("logp"), F.lit(0.0).alias("ref"), (F.col("rejected_logps") + 0.2).alias("kl_policy"), "ref_rejected_logps")


@query(
    "kto_loss",
    f"""WITH {UNPAIRED} SELECT row_id, {q6(f'{B} * u')} AS reward,
          {q6(f"CASE WHEN label THEN 1.33::DOUBLE * (1 - {sg(f'{B} * (u - kl)')}) ELSE 1 - {sg(f'{B} * (kl - u)')} END")} AS loss,
          {q6(f"CASE WHEN label THEN 1 - {sg(f'{B} * u')} ELSE {sg(f'{B} * u')} END")} AS loss_apo FROM a""",
    ("pair_logps",),
)
def _(t):
    rows = unpaired(t)
    kl = P.kl_baseline(rows, "kl_policy", "ref_rejected_logps")
    out = P.unpaired_kto(rows, "logp", "ref", "label", kl, desirable=1.33)
    apo = P.unpaired_kto(out.withColumnRenamed("loss", "kto"), "logp", "ref", "label", kind="apo_zero_unpaired")
    return apo.select("row_id", r6(F.col("reward")).alias("reward"), r6(F.col("kto")).alias("loss"), r6(F.col("loss")).alias("loss_apo"))


def newton_sql(steps: int = 12) -> str:
    """The balanced logistic fit as SQL: per step the sums, a Gauss-Jordan elimination row by row, and the next point."""
    parts = [
        """fit AS MATERIALIZED (SELECT rec_id, chunk_no, list_append(embedding, 1.0::DOUBLE) AS v, (label < 5)::INT AS y,
             count(*) OVER () / (2 * count(*) OVER (PARTITION BY label < 5)) AS s FROM chunks)""",
        "w0 AS MATERIALIZED (SELECT list_transform(any_value(v), lambda x: 0.0::DOUBLE) AS w, len(any_value(v)) AS d FROM fit)",
    ]
    for k in range(steps):
        parts += [
            f"p{k} AS MATERIALIZED (SELECT v, y, s, 1 / (1 + exp(-list_dot_product(v, w))) AS p FROM fit, w{k})",
            f"""h{k} AS MATERIALIZED (SELECT i, j, sum(s * p * (1 - p) * v[i] * v[j]) + any_value(CASE WHEN i = j AND i < d THEN 1 ELSE 0 END) AS h
                  FROM p{k}, w{k}, range(1, d + 1) a(i), range(1, d + 1) b(j) GROUP BY i, j)""",
            f"""g{k} AS MATERIALIZED (SELECT i, sum(s * (p - y) * v[i]) + any_value(CASE WHEN i < d THEN w[i] ELSE 0 END) AS g
                  FROM p{k}, w{k}, range(1, d + 1) a(i) GROUP BY i)""",
            f"m{k} AS MATERIALIZED (SELECT list(list_append(r, g) ORDER BY i) AS m FROM (SELECT i, list(h ORDER BY j) AS r FROM h{k} GROUP BY i) JOIN g{k} USING (i))",
            f"""s{k}(step, m) AS (SELECT 0::BIGINT, m FROM m{k} UNION ALL
                  SELECT step, list_transform(m, lambda r, i: CASE WHEN i = step THEN top ELSE list_transform(list_zip(r, top), lambda z: z[1] - r[step] * z[2]) END)
                  FROM (SELECT step + 1 AS step, m, list_transform(m[step + 1], lambda x: x / m[step + 1][step + 1]) AS top FROM s{k} WHERE step < len(m)))""",
            f"""w{k + 1} AS MATERIALIZED (SELECT list_transform(list_zip(w, m), lambda z: z[1] - z[2][d + 1]) AS w, d
                  FROM w{k}, s{k} WHERE step = d)""",
        ]
    last = f"w{steps}"
    parts.append(
        f"""density AS (SELECT rec_id, chunk_no, probability, least(greatest(probability / (1 - probability + 1e-8::DOUBLE), 0.5::DOUBLE), 10) AS weight
              FROM (SELECT rec_id, chunk_no, 1 / (1 + exp(-list_dot_product(v, w))) AS probability FROM fit, {last}))"""
    )
    return ",\n".join(parts)


def density(t):
    rows = t.chunks().withColumn("good", F.col("label") < 5)
    return P.with_density_weight(rows, P.fit_density(rows, "embedding", "good"), "embedding")


@query(
    "density_ratio",
    f"WITH RECURSIVE {newton_sql()} SELECT rec_id, chunk_no, {q6('probability')} AS probability, {q6('weight')} AS weight FROM density",
    ("chunks",),
)
def _(t):
    return rounded(density(t), ["rec_id", "chunk_no"], ["probability", "weight"])


@query(
    "bco_loss",
    f"""WITH RECURSIVE {newton_sql()}, {UNPAIRED}, d AS (SELECT avg({B} * u) AS delta FROM a),
          x AS (SELECT a.row_id, a.label, u, delta, coalesce(weight, 1) AS w FROM a CROSS JOIN d LEFT JOIN density ON row_id // 50 = rec_id AND row_id % 50 = chunk_no)
        SELECT row_id, {q6('w')} AS weight, {q6(f'{B} * u')} AS reward,
          {q6(f"CASE WHEN label THEN -{ls(f'{B} * u - delta')} ELSE -w * {ls(f'-({B} * u - delta)')} END")} AS loss FROM x""",
    ("pair_logps", "chunks"),
)
def _(t):
    weights = density(t).select((F.col("rec_id") * 50 + F.col("chunk_no")).alias("row_id"), "weight")
    rows = unpaired(t).join(weights, "row_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    out = P.unpaired_bco(rows, "logp", "ref", "label", weight=F.col("weight"))
    return rounded(out, ["row_id"], ["weight", "reward", "loss"])


ODDS = "(c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))"
CR = "q AS (SELECT row_id, chosen_logps AS c, rejected_logps AS r FROM pair_logps)"


@query(
    "orpo",
    f"""WITH {CR} SELECT row_id, {q6(ODDS)} AS log_odds, {q6(ls(ODDS))} AS ratio, {q6(f'{B} * ' + ls(ODDS))} AS loss FROM q""",
    ("pair_logps",),
)
def _(t):
    log_odds, ratio = L.odds_ratio(F.col("chosen_logps"), F.col("rejected_logps"))
    rows = t.pair_logps().select("row_id", log_odds.alias("log_odds"), ratio.alias("ratio"), (0.1 * ratio).alias("loss"))
    return rounded(rows, ["row_id"], ["log_odds", "ratio", "loss"])


@query(
    "cpo",
    f"""WITH {CR}, x AS (SELECT *, c - r AS z, (1 - exp(-0.5::DOUBLE * c)) / 0.5::DOUBLE AS uc, (1 - exp(-0.5::DOUBLE * r)) / 0.5::DOUBLE AS ur FROM q)
        SELECT row_id, {q6(f"-{ls(f'{B} * z')}")} AS sigmoid, {q6(f"-{ls(f'{B} * (z - 5)')}")} AS simpo, {q6(f'greatest(1 - {B} * z, 0)')} AS hinge,
          {q6('pow(z - 5, 2)')} AS ipo, {q6(f"-{ls(f'{B} * (uc - ur)')}")} AS alpha, {q6(f'{B} * uc')} AS alpha_reward FROM x""",
    ("pair_logps",),
)
def _(t):
    c, r = F.col("chosen_logps"), F.col("rejected_logps")
    kinds = {k: L.contrastive(k, c, r)[0] for k in ("sigmoid", "simpo", "hinge", "ipo")}
    alpha = L.contrastive("sigmoid", c, r, alpha=0.5)
    rows = t.pair_logps().select("row_id", *[v.alias(k) for k, v in kinds.items()], alpha[0].alias("alpha"), alpha[1].alias("alpha_reward"))
    return rounded(rows, ["row_id"], [*kinds, "alpha", "alpha_reward"])


@query(
    "reward_model_loss",
    f"""WITH {CR} SELECT row_id, {q6('-' + ls('c - r'))} AS plain, {q6(f"-{ls('c - r - 0.2::DOUBLE')} + 0.01::DOUBLE * pow(c + r, 2)")} AS full_loss,
          {q6('exp(c) / (exp(c) + exp(r))')} AS probability FROM q""",
    ("pair_logps",),
)
def _(t):
    c, r = F.col("chosen_logps"), F.col("rejected_logps")
    return t.pair_logps().select(
        "row_id",
        r6(L.reward_model(c, r)).alias("plain"),
        r6(L.reward_model(c, r, F.lit(0.2), 0.01)).alias("full_loss"),
        r6(L.pair_probability(c, r)).alias("probability"),
    )


XPO = """s AS (SELECT advantage >= 0 AS own, list_sum(logps) AS mm, list_sum(old) AS mr, list_sum(list_transform(old, lambda x: x * 1.1::DOUBLE + 0.000314159::DOUBLE)) AS rr, list_sum(ref) AS rm, score FROM token_logps),
       c AS (SELECT *, CASE WHEN own THEN mm ELSE mr END AS cm, CASE WHEN own THEN rm ELSE rr END AS cr,
               CASE WHEN own THEN mr ELSE mm END AS jm, CASE WHEN own THEN rr ELSE rm END AS jr FROM s),
       l AS (SELECT *, (cm - cr) - (jm - jr) AS z, 0.1::DOUBLE * (cm - cr) AS w, 0.1::DOUBLE * (jm - jr) AS v FROM c)"""
XPO_SQL = {
    "loss": f"avg(-{ls(f'{B} * z')} + 0.01::DOUBLE * mr)", "loss_dpo": f"avg(-{ls(f'{B} * z')})", "loss_xpo": "avg(0.01::DOUBLE * mr)",
    "logps_chosen": "avg(cm) + avg(cr)", "logps_rejected": "avg(jm) + avg(jr)", "rewards_chosen": "avg(w)", "rewards_rejected": "avg(v)",
    "objective_kl": "avg(mm - rm + mr - rr) / 2", "objective_entropy": "-(avg(mm) + avg(mr)) / 2", "rewards_margins": "avg(w - v)",
    "rewards_accuracies": "avg((w - v > 0)::INT)", "objective_model_scores": "avg(score)",
}


@query("xpo", f"WITH {XPO} SELECT " + ", ".join(f"{q6(e)} AS {k}" for k, e in XPO_SQL.items()) + " FROM l", ("token_logps",))
def _(t):
    rows = t.token_logps().withColumn("ref_ref", F.transform("old", lambda x: x * 1.1 + 0.000314159)).withColumn("own", F.col("advantage") >= 0)
    scored = P.exploratory_rows(rows, "logps", "old", "ref_ref", "ref", "own", alpha=0.01)
    return rounded(P.exploratory_report(scored, {"objective_model_scores": F.col("score")}), [], list(XPO_SQL))


NASH_SQL = {
    "loss": "avg(0.1::DOUBLE * wk - s)", "loss_score": "avg(s)", "loss_kl": "avg(m - r)", "logps_chosen": "avg(m)", "logps_rejected": "avg(r)",
    "rewards_probabilities": "avg(p)", "objective_entropy": "avg(-m)", "rewards_margins": "avg(m - r)", "rewards_accuracies": "avg((m - r > 0)::INT)",
}


@query(
    "nash_md",
    """WITH a AS (SELECT list_sum(logps) AS m, list_sum(ref) AS r, (row_id % 11) / 10::DOUBLE AS p,
          list_sum(list_transform(list_zip(logps, ref), lambda z: (z[1] - z[2]) * z[1])) AS wk FROM token_logps), b AS (SELECT *, (p - 0.5::DOUBLE) * m AS s FROM a)
       SELECT """ + ", ".join(f"{q6(e)} AS {k}" for k, e in NASH_SQL.items()) + " FROM b",
    ("token_logps",),
)
def _(t):
    rows = t.token_logps().withColumn("p", F.col("row_id") % 11 / 10.0)
    return rounded(P.nash_report(P.nash_rows(rows, "logps", "ref", "p"), "p"), [], list(NASH_SQL))


SIDES = [("rewards", "r1"), ("logps", "r2")]


@query(
    "metric_weighted_mean",
    "WITH s AS (SELECT CASE WHEN gen_no % 7 = 0 THEN 'eval' ELSE 'train' END AS mode, terminated AS label, r1, r2 FROM scored), x AS (SELECT mode, "
    + ", ".join(
        f"sum({v}) FILTER (WHERE {c}) / count(*) FILTER (WHERE {c}) AS {n}_{side}"
        for n, v in SIDES
        for side, c in (("chosen", "label"), ("rejected", "NOT label"))
    )
    + ", count(*) FILTER (WHERE label) AS count_chosen, count(*) FILTER (WHERE NOT label) AS count_rejected FROM s GROUP BY mode) SELECT mode, count_chosen, count_rejected, "
    + ", ".join(f"{q6(f'{n}_{side}')} AS {n}_{side}" for n, _ in SIDES for side in ("chosen", "rejected"))
    + f", {q6('rewards_chosen - rewards_rejected')} AS margins FROM x",
    ("scored",),
)
def _(t):
    rows = t.scored().select(
        F.when(F.col("gen_no") % 7 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("mode"),
        F.col("terminated").alias("label"), F.col("r1").alias("rewards"), F.col("r2").alias("logps"),
    )
    out = M.side_means(rows, "mode", "label", ["rewards", "logps"])
    return rounded(
        out, ["mode", "count_chosen", "count_rejected"],
        ["rewards_chosen", "rewards_rejected", "logps_chosen", "logps_rejected", "margins"],
    )


@query(
    "metric_mean",
    f"SELECT CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric, {q6('avg(value)')} AS value FROM metric_log GROUP BY mode, metric",
    ("metric_log",),
)
def _(t):
    return rounded(M.mean_metrics(t.metric_log()), ["metric"], ["value"])


@query(
    "perplexity",
    f"SELECT mode, {q6('avg(value / 100)')} AS mean_loss, {q6('exp(avg(value / 100))')} AS perplexity FROM metric_log GROUP BY mode",
    ("metric_log",),
)
def _(t):
    log = t.metric_log().select("mode", (F.col("value") / 100).alias("loss"))
    return rounded(M.perplexity(log, "mode", "loss"), ["mode"], ["mean_loss", "perplexity"])


@query(
    "best_checkpoint",
    "SELECT step, value AS loss FROM metric_log WHERE mode = 'eval' ORDER BY value, step LIMIT 1",
    ("metric_log",),
)
def _(t):
    return M.best_checkpoint(t.metric_log().filter(F.col("mode") == "eval"), "step", "value")


@query("newest_checkpoints", "SELECT DISTINCT step FROM metric_log ORDER BY step DESC LIMIT 3", ("metric_log",))
def _(t):
    return M.newest_checkpoints(t.metric_log(), "step", 3)
