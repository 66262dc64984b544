import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.operators import packing as K
from pairloom.operators import prep as P
from pairloom.functions import ordered


def arr(spark, make, **arrays):
    names = list(arrays)
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{n} array<int>" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("r")).first()["r"]


def test_truncation(spark):
    assert arr(spark, lambda x: A.truncate(x, 3, "keep_end"), x=[1, 2, 3, 4, 5]) == [3, 4, 5]
    assert arr(spark, lambda x: A.truncate(x, 3, "keep_start"), x=[1, 2, 3, 4, 5]) == [1, 2, 3]
    assert arr(spark, lambda x: A.truncate(x, 9, "keep_end"), x=[1, 2]) == [1, 2]
    assert arr(spark, lambda x: A.last_n_keeping(x, 3, [9]), x=[9, 1, 2, 3, 4]) == [9, 3, 4]
    assert arr(spark, lambda x: A.last_n_keeping(x, 3, [9]), x=[1, 9, 2, 9, 9]) == [9, 9, 9]
    assert arr(spark, lambda x: A.last_n_keeping(x, 9, [9]), x=[1, 9]) == [1, 9]
    with pytest.raises(ValueError):
        A.truncate(F.col("x"), 3, "middle")


def test_eos_and_preference_example(spark):
    assert arr(spark, lambda c: A.first_n(A.add_eos(c, 50256), 3), c=[4171]) == [4171, 50256]
    assert arr(spark, lambda c: A.add_eos(c, 7), c=[1, 7]) == [1, 7]
    assert arr(spark, lambda c: A.add_eos(c, 7), c=[]) == [7]
    assert arr(spark, lambda c: A.add_bos(c, 5), c=[5, 1]) == [5, 1]
    assert arr(spark, lambda c: A.mask_after_eos(c, 0), c=[4, 0, 3, 0]) == [1, 1, 0, 0]
    assert arr(spark, lambda c: A.cut_after_eos(c, 0, 9), c=[4, 5]) == [4, 5]
    assert arr(spark, lambda c: A.drop_unterminated(A.mask_after_eos(c, 0), c, 0), c=[4, 5]) == [0, 0]


def test_padding(spark):
    assert arr(spark, lambda x: A.pad_right(x, 4, 0), x=[1, 2]) == [1, 2, 0, 0]
    assert arr(spark, lambda x: A.attention_mask(x, 3), x=[1, 2, 3, 4]) == [1, 1, 1]
    assert arr(spark, lambda x: A.pads_to_right(x, 0), x=[0, 0, 1, 0, 2]) == [1, 2, 0, 0, 0]
    assert arr(spark, lambda x: A.left_pad_count(x, 2, 0), x=[0, 0, 1, 0, 0]) == 2
    got = arr(spark, lambda x: A.shifted_mask(x, F.lit(0), F.lit(3), 0), x=[8, 8, 8, 5, 5, 5, 0, 0, 0])
    assert got == [0, 0, 0, 1, 1, 1, 0, 0, 0]


def test_stepwise(spark):
    df = spark.createDataFrame([([[1, 2], [3, 4, 5]], [True, False])], "s array<array<int>>, l array<boolean>")
    row = df.select(
        A.stepwise_labels(F.col("s"), F.col("l"), [9]).alias("all"),
        A.stepwise_labels(F.col("s"), F.col("l"), [9], True).alias("last"),
        A.stepwise_ids(F.col("s"), [9]).alias("ids"),
    ).first()
    assert row["all"] == [-100, -100, 1, -100, -100, -100, 0]
    assert row["last"] == [-100] * 6 + [0]
    assert row["ids"] == [1, 2, 9, 3, 4, 5, 9]


def test_pair_budget(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(8)), list(range(3)))], "prompt array<int>, chosen array<int>, rejected array<int>")
    row = P.truncate_pair(df, 12, 5).first()
    assert row["prompt"] == [5, 6, 7, 8, 9] and len(row["chosen"]) == 7 and len(row["rejected"]) == 3
    assert P.truncate_pair(df, 18, 5).first()["prompt"] == list(range(10))


def test_splits(spark):
    df = spark.range(185).withColumnRenamed("id", "row_id")
    first = {r["row_id"]: r["split"] for r in P.split_exact(df, "row_id").collect()}
    again = {r["row_id"]: r["split"] for r in P.split_exact(df.repartition(7), "row_id").collect()}
    assert first == again and list(first.values()).count("val") == 19 and len(first) == 185
    parts = P.split_ordered(df, "row_id").orderBy("row_id").collect()
    assert [r["split"] for r in parts] == ["train"] * 166 + ["val"] * 19
    assert P.sample_exact(df, "row_id", 30).distinct().count() == 30
    assert P.sample_exact(df, "row_id", 500).count() == 185


def test_order_statistics(spark):
    rng = random.Random(5)
    values = [(rng.choice([1, 1, 1, 5, 7, 10**15 + 1, -3]), i) for i in range(200)]
    df = spark.createDataFrame(values, "a bigint, b bigint")
    wanted = sorted(values)
    for k in (1, 2, 57, 100, 199, 200):
        assert tuple(ordered.kth_smallest(df, ["a", "b"], k)) == wanted[k - 1]
    assert ordered.kth_smallest(df, ["a", "b"], 201) is None and ordered.kth_smallest(df, ["a"], 0) is None
    wide = [float("-inf"), -1e308, -2.0, -2.0, 0.0, 3.5, 1e308, float("inf"), float("inf")]
    mixed = spark.createDataFrame([(v,) for v in [*wide, float("nan"), None]], "v double")
    assert [ordered.kth_smallest(mixed, ["v"], k)["v"] for k in range(1, 10)] == wide
    assert math.isnan(ordered.kth_smallest(mixed, ["v"], 10)["v"]) and ordered.kth_smallest(mixed, ["v"], 11) is None
    numbers = sorted(rng.gauss(0, 3) for _ in range(101))
    frame = spark.createDataFrame([(v,) for v in numbers], "v double")
    for q in (0.0, 0.25, 0.333, 0.8, 1.0):
        at = q * 100
        low = math.floor(at)
        want = numbers[low] + (numbers[min(low + 1, 100)] - numbers[low]) * (at - low)
        assert ordered.exact_quantile(frame, "v", q) == pytest.approx(want)


def test_blocked_scans_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else "cold", i, rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for size in (1, 7, 1000):
        block = F.floor(F.col("i") / size)
        inclusive = ordered.running_sums(df, ["k"], block, ["i"], {"s": F.col("v")}).collect()
        exclusive = ordered.running_sums(df, ["k"], block, ["i"], {"s": F.col("v")}, inclusive=False).collect()
        before = {r["i"]: r["p"] for r in ordered.neighbours(df, ["k"], block, ["i"], "v", "p", -1).collect()}
        after = {r["i"]: r["p"] for r in ordered.neighbours(df, ["k"], block, ["i"], "v", "p", 1).collect()}
        want_in, want_ex, want_before, want_after = {}, {}, {}, {}
        total, last = {}, {}
        for k, i, v in rows:
            want_ex[i], want_before[i] = total.get(k, 0), (last[k][1] if k in last else None)
            if k in last:
                want_after[last[k][0]] = v
            total[k] = total.get(k, 0) + v
            want_in[i], last[k], want_after[i] = total[k], (i, v), None
        assert {r["i"]: r["s"] for r in inclusive} == want_in
        assert {r["i"]: r["s"] for r in exclusive} == want_ex
        assert before == want_before and after == want_after


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    rows = [(i, [i] * rng.choice([0, 1, 3, 9, 25])) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, ids array<int>")
    tokens = sorted(x for _, ids in rows for x in ids)
    for packed in (K.pack_wrapped(df, "row_id", 10, batch_rows=20), K.pack_best_fit(df, "row_id", 10, batch_rows=20)):
        got = packed.collect()
        assert sorted(x for r in got for x in r["ids"]) == tokens
        assert all(0 < len(r["ids"]) <= 10 for r in got)
    assert all(len(r["ids"]) == 10 for r in K.pack_wrapped(df, "row_id", 10, batch_rows=60).orderBy("pack").collect()[:-1])


def test_sparse_ids_pack_as_densely_as_consecutive_ones(spark):
    rng = random.Random(6)
    rows = [(i, [i] * rng.choice([0, 1, 3, 9, 25])) for i in range(60)]
    dense = spark.createDataFrame(rows, "row_id bigint, ids array<int>")
    sparse = dense.withColumn("row_id", (F.col("row_id") - 30) * 10**12 + 7)
    for pack in (K.pack_wrapped, K.pack_best_fit):
        packs = [sorted((r["batch"], r["pack"], r["ids"]) for r in pack(df, "row_id", 10, batch_rows=20).collect()) for df in (dense, sparse)]
        assert packs[0] == packs[1] and {r[0] for r in packs[0]} == {0, 1, 2}


def test_best_fit_against_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 25))]
        room, bins = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
            fits = [(free, b) for b, free in enumerate(room) if free >= sizes[i]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(room)
                room.append(10)
            room[b] -= sizes[i]
            bins[i] = b
        assert K.best_fit(sizes, 10) == bins


def test_pairs_and_balance(spark):
    df = spark.createDataFrame([(1, "Q: a. yes", "Q: a. no")], "row_id int, chosen string, rejected string")
    row = P.extract_prompt(df).first()
    assert (row["prompt"], row["chosen"], row["rejected"]) == ("Q: a. ", "yes", "no")
    assert sorted((r["completion"], r["label"]) for r in P.unpair(df).collect()) == [("Q: a. no", False), ("Q: a. yes", True)]
    rows = spark.createDataFrame([(i < 30,) for i in range(40)], "label boolean")
    b = P.class_balance(rows).first()
    got = [b["desirable_low"], b["desirable_high"], b["undesirable_low"], b["undesirable_high"]]
    assert got == pytest.approx([0.33, 0.44, 2.26, 3.0], abs=0.011) and not b["balanced"]


def test_mismatch_and_repeat(spark):
    df = spark.createDataFrame([(i * 3, f"c{i}") for i in range(5)], "row_id bigint, completion string")
    got = {r["row_id"]: r["kl_row_id"] for r in P.mismatched_pairs(df, "row_id", 3).collect()}
    assert got == {0: 6, 3: 3, 6: 0, 9: 12, 12: 9}
    got = {r["row_id"]: r["kl_completion"] for r in P.mismatched_pairs(df, "row_id", 3, mode="rotate").collect()}
    assert got == {0: "c2", 3: "c0", 6: "c1", 9: "c4", 12: "c3"}
    rows = P.repeat_prompts(df, "row_id", copies=2, batch=2, repeats=3).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(30))
    order = [r["row_id"] for r in rows]
    assert order[0:4] == order[4:8] == order[8:12] and order[0] == order[1] != order[2]


def test_sample_with_replacement(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert P.sample_with_replacement(df, "row_id", 37).count() == 37


def test_format(spark):
    df = spark.createDataFrame([("in", "{} AAA"), ("in", "{}")], "i string, o string")
    texts = [r[0] for r in df.select(P.format_example(F.col("i"), F.col("o"))).collect()]
    assert texts[0] == texts[1] and texts[0].count("AAA") == 1
