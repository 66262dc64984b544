"""Streaming merge, the interval tree, Newton steps, order statistics, global ranks and split CSV."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import jsonx as J
from pairloom.functions import ordered
from pairloom.operators import cleaning as C
from pairloom.operators import entities as M
from pairloom.operators import preferences as Q
from pairloom.operators import prep as P
from pairloom.operators import transcripts as R
from pairloom.sources import pairs as S
from pairloom.streaming import landing as L

ENTITY = "conv_id int, chunk_no int, pos int, kind string, name string, dosage string, frequency string, duration string, route string, timing string"


def entity(conv, chunk, pos, kind, name, dosage=None):
    return (conv, chunk, pos, kind, name, dosage, None, None, None, None)


# -- streaming merge -----------------------------------------------------------------------
def test_late_chunks_and_restart_give_the_batch_table(spark, tmp_path):
    rnd = random.Random(3)
    rows = [
        entity(rnd.randrange(3), c, p, rnd.choice(["medicine", "test", "disease"]), rnd.choice(["Met", "met", "Asp", "", None, "X"]), f"{c}-{p}")
        for c in range(60)
        for p in range(3)
    ]
    rnd.shuffle(rows)  # chunks arrive in any order
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):  # each time the stream starts again from its checkpoint
        spark.createDataFrame(rows[part::3], ENTITY).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", 1).parquet(source)
        L.merge_stream(stream, out, state).awaitTermination()
        seen = [r for i in range(part + 1) for r in rows[i::3]]
        batch = M.first_of_key(spark.createDataFrame(seen, ENTITY))
        assert sorted(map(repr, L.merged(spark, out).collect())) == sorted(map(repr, batch.collect()))
    L.merge_stream(stream, out, state).awaitTermination()  # nothing new
    assert L.merged(spark, out).count() == batch.count()
    runs = spark.read.parquet(out).select("run").distinct().count()
    assert runs >= 3 and spark.read.parquet(out).count() < runs * batch.count()  # updates, not the whole table each time


def test_first_of_key(spark):
    rows = [entity(1, 2, 0, "medicine", "MET", "late"), entity(1, 1, 1, "medicine", "met", "early"), entity(1, 1, 0, "disease", "Flu"), entity(1, 0, 0, "disease", "flu"), entity(1, 0, 1, "disease", "")]
    got = {(r["kind"], r["key"]): (r["chunk_no"], r["dosage"]) for r in M.first_of_key(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == {("medicine", "met"): (1, "early"), ("disease", "Flu"): (1, None), ("disease", "flu"): (0, None)}


# -- interval tree -------------------------------------------------------------------------
def test_alignment_against_brute_force(spark):
    rnd = random.Random(8)
    length = lambda: rnd.choice([0.0, 0.5, 3.0, 64.0, 700.0, 1e5, 1e9])
    segs = [(rnd.randrange(2), i, s := rnd.uniform(-2000, 5000), s + rnd.choice([0.0, 1.0, 30.0, 5000.0]), "t") for i in range(150)]
    turns = [(rnd.randrange(2), s := rnd.uniform(-3000, 6000), s + length(), i) for i in range(120)] + [(0, 4000.0, math.inf, 500), (1, 10.0, 5.0, 501)]
    want = {}
    for rec, i, s, e, _ in segs:
        fits = [(-(min(e, te) - max(s, ts)), ts, lab) for r, ts, te, lab in turns if r == rec and min(e, te) - max(s, ts) > 0]
        want[i] = min(fits)[2] if fits else None
    left = spark.createDataFrame([*segs, (0, 999, None, None, "x")], "rec_id int, seg_no int, start double, end double, text string")
    right = spark.createDataFrame(turns, "rec_id int, start double, end double, label int")
    for share in (0.01, 0.75, 1.0):
        got = {r["seg_no"]: r["label"] for r in R.align_speakers(left, right, "rec_id", leaf_share=share).collect()}
        assert got == want | {999: None}


def test_huge_turns_stay_a_few_rows(spark):
    turns = spark.createDataFrame([(0, 5.0, 5.0 + 10.0**k) for k in range(12)] + [(0, 0.0, math.inf)], "rec_id int, start double, end double")
    rows = turns.withColumn("__own", R._level(F.col("start"), F.col("end")))
    alone = R._in_tree(rows, "start", "end", [], 0).groupBy("end").count().collect()
    assert max(r["count"] for r in alone) <= 3
    spread = R._in_tree(rows, "start", "end", list(range(R.ROOT_LEVEL + 1)), 0).groupBy("end").count().collect()
    assert max(r["count"] for r in spread) <= 3 * (R.ROOT_LEVEL + 1)


# -- Newton steps --------------------------------------------------------------------------
def test_density_fit_is_the_minimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    good = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.8).astype(bool)
    rows = [([float(v) for v in r], bool(g)) for r, g in zip(x, good)] + [(None, True), ([1.0, None, 2.0], False), ([0.0, 0.0, 0.0], None)]
    model = Q.fit_density(spark.createDataFrame(rows, "v array<double>, good boolean").repartition(5), "v", "good")
    weight = np.where(good, 300 / (2 * good.sum()), 300 / (2 * (~good).sum()))
    p = 1 / (1 + np.exp(-(x @ np.array(model.coefficients) + model.intercept)))
    slope = x.T @ (weight * (p - good)) + np.array(model.coefficients)
    assert np.abs(slope).max() < 1e-8 and abs((weight * (p - good)).sum()) < 1e-8
    scored = Q.with_density_weight(spark.createDataFrame(rows[:300], "v array<double>, good boolean"), model, "v")
    got = [r["probability"] for r in scored.collect()]
    assert np.allclose(sorted(got), sorted(p))
    with pytest.raises(ValueError):
        Q.fit_density(spark.createDataFrame([], "v array<double>, good boolean"), "v", "good")


def test_sorted_losses_go_back_to_rows(spark):
    rng = random.Random(4)
    rows = [(f"id{i:03d}", *(-rng.randrange(1, 40) / 8 for _ in range(4))) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id string, chosen_logps double, rejected_logps double, ref_chosen_logps double, ref_rejected_logps double")
    sig = lambda v: math.log1p(math.exp(-v))
    left, right = sorted(r[1] - r[2] for r in rows), sorted(r[3] - r[4] for r in rows)
    out = Q.mixed_loss(df, {"sigmoid": 0.5, "aot": 2.0}, row_weight=F.lit(3.0), key="row_id")
    got = {r["row_id"]: r["loss"] for r in out.collect()}
    for i, (key, c, r, rc, rr) in enumerate(rows):
        assert got[key] == pytest.approx(3 * (0.5 * sig(0.1 * (c - r - rc + rr)) + 2 * sig(0.1 * (left[i] - right[i]))))
    with pytest.raises(ValueError):
        Q.mixed_loss(df, {"aot": 1.0})


# -- order statistics and ranks ------------------------------------------------------------
def test_order_statistics_where_the_sketch_is_refined(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SKETCH", 64)
    monkeypatch.setattr(ordered, "EXACT", 50)
    monkeypatch.setattr(ordered, "MARGIN", 0.01)
    rng = random.Random(6)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 0.25, 7.0]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    values.sort()
    for k in (1, 2, 5_000, 10_000, 19_999, 20_000):
        assert ordered.kth_smallest(df, ["v"], k)["v"] == values[k - 1]
    third = ordered.order_statistics(df, ["v"], F.floor(F.col("n") / 3), 3)
    assert [r["v"] for r in third] == values[6665:6668]
    assert ordered.order_statistics(df, ["v"], F.col("n"), 2)[1] is None


def test_order_statistics_read_twice(spark, tmp_path):
    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(str(tmp_path / "t"))

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert ordered.kth_smallest(df.mapInArrow(counting, "id bigint"), ["id"], 777)["id"] == 776
    assert seen.value == 100_000


@pytest.mark.parametrize("name", ["hashed", "sparse"])
def test_numbers_follow_any_key(spark, name):
    key = F.md5(F.col("id").cast("string")) if name == "hashed" else F.col("id") * 10**15 - 7
    df = spark.range(500).select(key.alias("k"), F.col("id").alias("x"))
    rows = ordered.numbered(df, ["k"], "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(500)) and set(rows[0].asDict()) == {"k", "x", "n"}
    assert ordered.numbered(df.limit(0), ["k"], "n").count() == 0
    pairs = P.mismatched_pairs(df.withColumnRenamed("x", "completion"), "k", 7).collect()
    places = {r["k"]: r["n"] for r in rows}
    assert all(places[p["k"]] // 7 == places[p["kl_k"]] // 7 for p in pairs) and len(pairs) == 500


# -- records -------------------------------------------------------------------------------
def test_tail_without_an_end_is_not_collected(spark):
    lines = [("a", i, "no end here") for i in range(200)] + [("b", 0, "x"), ("b", 1, "y}"), ("b", 2, "tail"), ("c", 0, 'z}"')]
    df = spark.createDataFrame(lines, "file string, line_no int, line string")
    for block in (1, 3, 1000):
        got = C.reassemble(df, F.floor(F.col("line_no") / block)).collect()
        assert sorted((r["file"], r["record_no"], r["text"]) for r in got) == [("b", 0, "x y}"), ("c", 0, 'z}"')]


def test_csv_in_splits(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for i in range(4000):
        cell = "".join(rnd.choice(['"', "\n", ",", "a", "b ", "\r\n", "é"]) for _ in range(rnd.randrange(8)))
        rows.append((f"{i} {cell}.", None if i % 5 == 0 else f'{{"k": "{i}"}}'))
    path = str(tmp_path / "csv")
    S.write_csv(spark.createDataFrame(rows, "input string, output string").coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = S.read_csv_split(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert sorted((r["input"], r["output"] or "") for r in got.collect()) == sorted((a, b or "") for a, b in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_balanced_object_without_python(spark):
    df = spark.createDataFrame([("x " * 5 + "{" * 300 + "}" * 300 + " {",), (None,), ("",), ("é{a}",)], "t string").select(J.balanced_object(F.col("t")).alias("r"))
    assert [r["r"] for r in df.collect()] == ["{" * 300 + "}" * 300, None, None, "{a}"]
    assert "Python" not in df._jdf.queryExecution().toString()
