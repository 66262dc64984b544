import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import losses as L
from pairloom.functions.mathx import log_sigmoid, sigmoid, softplus
from pairloom.operators import metrics as M
from pairloom.operators import preferences as P
from pairloom.operators import rollouts as R
from pairloom.streaming import landing as S


def test_stable_functions(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double")
    rows = df.select(log_sigmoid(F.col("x")).alias("l"), sigmoid(F.col("x")).alias("s"), softplus(F.col("x")).alias("p")).collect()
    assert [r["l"] for r in rows] == pytest.approx([-1000.0, -math.log(2), 0.0])
    assert [r["s"] for r in rows] == pytest.approx([0.0, 0.5, 1.0])
    assert [r["p"] for r in rows] == pytest.approx([0.0, math.log(2), 1000.0])


def rewards(spark, rows):
    return spark.createDataFrame(rows, "g string, i int, reward double")


def test_reward_columns(spark):
    df = spark.createDataFrame([(None, float("nan")), (1.0, None)], "a double, b double")
    rows = R.with_rewards(df, {"x": F.col("a"), "y": F.col("b")}).withColumn("r", R.reward_sum(["x", "y"], [1, 2])).collect()
    assert [(r["unscored"], r["r"]) for r in rows] == [(True, 0.0), (False, 1.0)]


def test_group_advantages(spark):
    df = rewards(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("c", 0, 2.0), ("c", 1, 2.0), ("s", 0, 5.0)])
    got = {(r["g"], r["i"]): r for r in R.group_advantages(df, "g").collect()}
    assert got["a", 0]["advantage"] == pytest.approx(-0.70706, abs=1e-5)
    assert got["a", 1]["advantage"] == pytest.approx(0.70706, abs=1e-5)
    assert got["c", 0]["advantage"] == 0 and got["c", 0]["zero_std"]
    assert got["s", 0]["advantage"] is None
    assert R.group_advantages(df, "g", scale="none").filter("g = 's'").first()["advantage"] == 0.0


def test_leave_one_out(spark):
    df = rewards(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("s", 0, 5.0)])
    got = {(r["g"], r["i"]): r["advantage"] for r in R.leave_one_out_advantages(df, "g").collect()}
    assert got == {("a", 0): -1.5, ("a", 1): 0.0, ("a", 2): 1.5, ("s", 0): None}


def test_length_stats_without_terminated(spark):
    df = spark.createDataFrame([(3,), (5,)], "n int")
    row = R.length_stats(df, F.col("n"), F.lit(False)).first()
    assert row["clipped_ratio"] == 1.0 and row["mean_terminated_length"] == 0 and row["max_terminated_length"] == 0


def test_gae_and_token_rewards(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.5, 0.5])], "r array<double>, v array<double>")
    assert df.select(R.gae(F.col("r"), F.col("v"), 1.0, 0.95).alias("a")).first()["a"] == pytest.approx([0.475, 0.5])
    logs = spark.createDataFrame([([-1.0, -2.0, -1.0], [-1.5, -1.0, -1.0])], "p array<double>, q array<double>")
    for length, place in ((3, 2), (1, 1)):
        got = logs.select(R.token_rewards(F.col("p"), F.col("q"), F.lit(length), F.lit(2.0), 0.1).alias("t")).first()["t"]
        want = [-0.05, 0.1, 0.0]
        want[place] += 2.0
        assert got == pytest.approx(want)


def test_whiten(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0], [1, 1, 0]), ([4.0, 6.0], [1, 1])], "v array<double>, m array<int>")
    got = [x for r in R.whiten(df, "v", "m").collect() for x in r["v"]]
    kept = np.array([1.0, 2.0, 4.0, 6.0])
    want = (kept - kept.mean()) / np.sqrt(kept.var(ddof=1) + 1e-8)
    assert got == pytest.approx([want[0], want[1], 0.0, want[2], want[3]])


def test_entropy_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0, 99.0], [1, 1, 0]), ([3.0, 4.0, 5.0], [1, 1, 1])], "e array<double>, m array<int>")
    rows = R.entropy_mask(df, "e", "m", 0.75).collect()
    assert [r["entropy_mask"] for r in rows] == [[0, 0, 0], [0, 1, 1]]
    empty = spark.createDataFrame([([1.0], [0])], "e array<double>, m array<int>")
    assert R.entropy_mask(empty, "e", "m", 0.5).first()["entropy_mask"] == [0]


def test_pair_by_reward_tie(spark):
    df = spark.createDataFrame([("p", 0, 1.0, "first"), ("p", 1, 1.0, "second")], "p string, i int, r double, c string")
    row = R.pair_by_reward(df, "p", "i", "r", "c").first()
    assert (row["chosen"], row["rejected"], row["margin"]) == ("first", "second", 0.0)


def test_equal_logps(spark):
    df = spark.createDataFrame([(-1.0, -1.0, -1.0, -1.0)], ", ".join(f"{c} double" for c in P.COLUMNS))
    row = P.with_losses(df, ["sigmoid", "hinge", "ipo"]).first()
    assert row["loss_sigmoid"] == pytest.approx(math.log(2))
    assert row["loss_hinge"] == pytest.approx(1.0) and row["loss_ipo"] == pytest.approx(25.0)


def test_sorted_pairs_with_heavy_ties(spark):
    rng = np.random.default_rng(8)
    a = np.where(rng.random(500) < 0.6, 1.0, rng.normal(size=500).round(2))
    b = rng.normal(size=500)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    rows = P.sorted_pairs(df, F.col("a"), F.col("b"), slot=64).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(500))
    assert [r["a"] for r in rows] == sorted(a.tolist()) and [r["b"] for r in rows] == sorted(b.tolist())


def test_sequence_scores(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -3.0], [1, 1, 0])], "p array<double>, m array<int>")
    p, m = F.col("p"), F.col("m")
    row = df.select(
        P.sequence_logp(p, m).alias("s"), P.sequence_logp(p, m, True).alias("a"), P.desensitised_logp(p, m, F.lit(1), 0.5).alias("d")
    ).first()
    assert (row["s"], row["a"], row["d"]) == (-3.0, -1.5, -2.0)


def test_density_ratio(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0.5, 1, (60, 3)), rng.normal(-0.5, 1, (20, 3))])
    y = np.array([True] * 60 + [False] * 20)
    df = spark.createDataFrame([(v.tolist(), bool(g)) for v, g in zip(x, y)], "e array<double>, good boolean")
    model = P.fit_density(df, "e", "good")
    # the same penalised objective, minimised by Newton steps
    sw = np.where(y, 80 / 120, 80 / 40)
    w = np.zeros(4)
    xb = np.hstack([x, np.ones((80, 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ w))
        grad = xb.T @ (sw * (p - y)) + np.r_[w[:3], 0]
        hess = (xb * (sw * p * (1 - p))[:, None]).T @ xb + np.diag([1, 1, 1, 0])
        w -= np.linalg.solve(hess, grad)
    assert model.coefficients == pytest.approx(w[:3], abs=1e-3) and model.intercept == pytest.approx(w[3], abs=1e-3)
    got = P.with_density_weight(df, model, "e").agg(F.min("weight"), F.max("weight")).first()
    assert 0.5 <= got[0] and got[1] <= 10.0


def test_contrastive_and_odds(spark):
    df = spark.createDataFrame([(-0.5, -1.5)], "c double, r double")
    c, r = F.col("c"), F.col("r")
    loss, up, down = L.contrastive("simpo", c, r)
    row = df.select(loss.alias("l"), up.alias("u"), L.odds_ratio(c, r)[0].alias("o")).first()
    assert row["l"] == pytest.approx(math.log1p(math.exp(-0.1 * (1 - 5)))) and row["u"] == pytest.approx(-0.05)
    want = 1.0 - (math.log1p(-math.exp(-0.5)) - math.log1p(-math.exp(-1.5)))
    assert row["o"] == pytest.approx(want)
    with pytest.raises(ValueError):
        L.contrastive("other", c, r)


def test_side_means_count_missing_rows(spark):
    df = spark.createDataFrame([("train", True, 4.0), ("train", True, None), ("train", False, 1.0), ("eval", True, 3.0)], "mode string, label boolean, rewards double")
    got = {r["mode"]: r for r in M.side_means(df, "mode", "label", ["rewards"]).collect()}
    assert got["train"]["rewards_chosen"] == 2.0 and got["train"]["margins"] == 1.0
    assert got["eval"]["rewards_rejected"] is None and got["eval"]["margins"] is None


def test_checkpoints(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3), (4, 0.9)], "step int, loss double")
    assert M.best_checkpoint(df, "step", "loss").first()["step"] == 2
    assert [r["step"] for r in M.newest_checkpoints(df, "step").collect()] == [4, 3, 2]


def test_landing_stream(spark, tmp_path):
    good = '{"input": "é", "output": "{\\"medicines\\":[],\\"diseases\\":[],\\"symptoms\\":[],\\"tests\\":[],\\"instructions\\":[]}"}'
    folder = tmp_path / "in"
    folder.mkdir()
    base = str(tmp_path)

    def run():
        lines = S.landing_stream(spark, str(folder), files=1)
        S.validate_stream(lines, base + "/out", base + "/state").awaitTermination()
        return {(r["accepted"], r["batch"]): r["count"] for r in S.read_checked(spark, base + "/out").groupBy("accepted", "batch").count().collect()}

    (folder / "a.jsonl").write_text(good + "\n\n{bad\n")
    (folder / "b.jsonl").write_text(good + "\n" + good + "\n")
    assert run() == {(True, "a.jsonl"): 1, (False, "a.jsonl"): 1, (True, "b.jsonl"): 2}
    (folder / "c.jsonl").write_text("[]\n")
    assert run()[False, "c.jsonl"] == 1  # only the new file is read
    row = S.read_checked(spark, base + "/out").filter("accepted").first()
    assert row["output"].endswith(" AAA") and row["input"] == "é" and row["line"] is None


def test_running_mean_stream_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    base = str(tmp_path)
    for values in ([1.0, 3.0], [8.0]):
        spark.createDataFrame([("k", v) for v in values], "k string, v double").coalesce(1).write.mode("append").parquet(folder)
        stream = S.table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
        S.upsert_to(S.running_means(stream, "k", "v"), base + "/out", base + "/state").awaitTermination()
    row = S.latest(spark.read.parquet(base + "/out"), "k").first()
    assert (row["mean"], row["n"]) == (4.0, 3)


def test_null_groups_are_kept(spark):
    from pairloom.operators import rollouts

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "g string, reward double")
    assert [r.advantage for r in rollouts.group_advantages(df, "g", scale="none").orderBy("reward").collect()] == [-1.0, -2.0, 1.0, 2.0]
    assert [r.advantage for r in rollouts.leave_one_out_advantages(df, "g").orderBy("reward").collect()] == [-2.0, -4.0, 2.0, 4.0]
    assert rollouts.zscore_advantages(df, "reward", "g").count() == 4
