import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import entities as M
from pairloom.operators import speakers as K
from pairloom.operators import transcripts as R
from pairloom.operators.inference import apply_model


def test_windows(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 10.0), ("c", 30.0)], "rec_id string, d double")
    rows = R.window_chunks(df, "rec_id", F.col("d"), 16000, 30.0, 4.0).orderBy("rec_id", "chunk_no").collect()
    assert [(r["start"], r["end"]) for r in rows if r["rec_id"] == "a"] == [(0, 30), (26, 56), (52, 82), (70, 100)]
    assert [(r["start"], r["end"]) for r in rows if r["rec_id"] == "b"] == [(0, 10)]
    assert [(r["start"], r["end"]) for r in rows if r["rec_id"] == "c"] == [(0, 30)]


def chunks(spark, labels):
    rows = [("r", i, 26.0 * i, 26.0 * i + 30, v) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "rec_id string, chunk_no int, start double, end double, label int")


def test_smoothing(spark):
    assert R.smoothing_kernel(3, 30) == 1 and R.smoothing_kernel(0, 30) == 1
    assert R.smoothing_kernel(60, 30) == 3 and R.smoothing_kernel(75, 30) == 3  # 2.5 rounds to 2
    df = chunks(spark, [1, 1, 2, 1, 1])
    assert R.median_smooth(df, "rec_id", 1) is df
    for block in (1, 2, 4096):
        got = R.median_smooth(df, "rec_id", 3, block).orderBy("chunk_no").collect()
        assert [r["label"] for r in got] == [1, 1, 1, 1, 1]
    labels = np.random.default_rng(1).integers(0, 4, 57).tolist()
    padded = [0, 0, 0] + labels + [0, 0, 0]
    wanted = [int(np.median(padded[i : i + 7])) for i in range(57)]
    got = R.median_smooth(chunks(spark, labels), "rec_id", 7, 5).orderBy("chunk_no").collect()
    assert [r["label"] for r in got] == wanted


def test_label_segments(spark):
    for block in (1, 2, 3, 4096):
        got = R.label_segments(chunks(spark, [0, 0, 1, 0]), "rec_id", block).orderBy("start").collect()
        assert [(r["start"], r["end"], r["label"]) for r in got] == [(0, 52, 0), (52, 78, 1), (78, 108, 0)]
        same = R.label_segments(chunks(spark, [5] * 10), "rec_id", block).collect()
        assert [(r["start"], r["end"]) for r in same] == [(0, 26.0 * 9 + 30)]


def test_alignment(spark):
    seg = spark.createDataFrame(
        [("r", 0, 0.0, 10.0, " a "), ("r", 1, 20.0, 30.0, "b"), ("r", 2, 50.0, 52.0, "c"), ("r", 3, 3590.0, 3610.0, "d")],
        "rec_id string, seg_no int, start double, end double, text string",
    )
    turns = spark.createDataFrame(
        [("r", 10.0, 20.0, 1), ("r", 20.0, 25.0, 2), ("r", 25.0, 30.0, 3), ("r", 3000.0, 3595.0, 4), ("r", 3595.0, 7300.0, 5)],
        "rec_id string, start double, end double, label int",
    )
    rows = R.align_speakers(seg, turns, "rec_id").orderBy("seg_no").collect()
    assert [r["label"] for r in rows] == [None, 2, None, 5]
    lines = R.align_speakers(seg, turns, "rec_id").orderBy("seg_no").select(R.speaker_line(F.col("label"), F.col("text"))).collect()
    assert [r[0] for r in lines] == ["Unknown Speaker: a", "Speaker 3: b", "Unknown Speaker: c", "Speaker 6: d"]


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(a, b):
            ca, cb = x[a].mean(0), x[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(x)) != i)
        if not mates.any():
            scores.append(0.0)
            continue
        a = d[i][mates].mean()
        b = min(d[i][labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("seed", range(6))
def test_ward_and_silhouette_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(24, 4)) + rng.integers(0, 3, 24)[:, None] * 2.0
    merges = K._ward_merges(x)
    for k in range(2, 6):
        labels = K.ward_labels(len(x), merges, k)
        groups = sorted(np.flatnonzero(labels == g).tolist() for g in set(labels))
        assert groups == brute_ward(x, k)
        assert K.silhouettes(x, [labels], rows=7)[0] == pytest.approx(brute_silhouette(x, labels))


def test_small_recordings_and_large_ones(spark):
    rng = np.random.default_rng(3)
    rows = [("one", 0, [1.0, 0.0])]
    rows += [("two", i, [float(i), 1.0]) for i in range(2)]
    rows += [("big", i, [float(10 * (i % 3)) + float(rng.normal()) * 0.1, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "rec_id string, chunk_no int, embedding array<double>")
    got = K.cluster_speakers(df, "rec_id").collect()
    assert len(got) == 33
    ks = {r["rec_id"]: r["k"] for r in got}
    assert ks == {"one": 1, "two": 2, "big": 3}
    groups = {}
    for r in got:
        if r["rec_id"] == "big":
            groups.setdefault(r["chunk_no"] % 3, set()).add(r["label"])
    assert all(len(g) == 1 for g in groups.values())


def test_merge_entities(spark):
    rows = [
        (1, 0, "medicine", 0, "Metformin"), (1, 1, "medicine", 0, "metformin"), (1, 1, "medicine", 1, None), (1, 2, "medicine", 0, ""),
        (1, 0, "disease", 0, "flu"), (1, 0, "disease", 1, "flu"), (1, 1, "disease", 0, "Flu"), (1, 2, "disease", 0, "flu"), (1, 2, "disease", 1, ""),
    ]
    df = spark.createDataFrame(rows, "conv_id int, chunk_no int, kind string, pos int, name string")
    fields = ["dosage", "frequency", "duration", "route", "timing"]
    for c in fields:
        df = df.withColumn(c, F.lit(c[0]))
    named = M.merge_named(df).orderBy("chunk_no", "pos").collect()
    assert [(r["name"], r["chunk_no"]) for r in named] == [("Metformin", 0), (None, 1)]
    assert sorted(r["name"] for r in M.merge_values(df).collect()) == ["Flu", "flu"]
    concat = M.merge_concat(df).filter("kind = 'disease'").orderBy("chunk_no", "pos").collect()
    assert [(r["name"], r["chunk_no"]) for r in concat] == [("flu", 0), ("flu", 0), ("Flu", 1), ("", 2)]
    doc = M.merged_document(df).first()
    assert [m["name"] for m in doc["medicines"]] == ["Metformin", None] and doc["diseases"] == ["flu", "Flu"] and doc["tests"] == []
    assert all([m[c] for c in fields] == ["d", "f", "d", "r", "t"] for m in doc["medicines"])
    whole = M.merge_concat(df).filter("kind = 'medicine'").collect()
    assert len(whole) == 4 and all(m["route"] == "r" and m["timing"] == "t" for m in whole)


def test_model_retries(spark):
    def load():
        def model(texts, attempt):
            if attempt == 1 and "boom" in texts:
                raise RuntimeError("bad batch")
            return [None if t == "never" else f"{t}@{attempt}" for t in texts]

        return model

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "boom", "never", "b"])], "id int, text string").coalesce(1)
    got = {r["id"]: r for r in apply_model(df, load, "text", ["id"], batch_size=2).collect()}
    assert (got[0]["result"], got[0]["attempts"], got[0]["error"]) == ("a@2", 2, None)
    assert got[2]["result"] is None and got[2]["attempts"] == 2 and got[2]["error"] == "no result"
    assert got[3]["result"] == "b@1"


def test_transcript_slots(spark):
    rows = [("r", i, 700.0 * i, f" t{i} " if i % 3 else "  ") for i in range(20)]
    df = spark.createDataFrame(rows, "rec_id string, seg_no int, start double, text string")
    assert R.transcript(df, ["rec_id"]).first()["transcript"] == " ".join(f"t{i}" for i in range(20) if i % 3)
