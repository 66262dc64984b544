"""What a job moves and writes, and the cases its quick path must not lose."""

import glob
import os

from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.operators import cleaning as C
from pairloom.operators import prep as P
from pairloom.plans import lifecycle_queries, registry
from pairloom.sources import pairs as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- sources -------------------------------------------------------------------------------
def test_jsonl_is_packed_in_bounded_files(spark, tmp_path):
    path = str(tmp_path / "jsonl")
    rows = spark.range(0, 250_000, 1, 1).select(F.concat(F.lit("same text é "), F.col("id")).alias("input"), F.lit("out " * 20).alias("output"))
    S.write_jsonl(rows, path, packed=True)
    files = glob.glob(path + "/*.json.gz")
    assert len(files) == 3 and sum(map(os.path.getsize, files)) < 5_000_000
    assert S.read_jsonl(spark, path).select("input", "output").exceptAll(rows).isEmpty()


def test_csv_moves_only_pieces_at_borders(spark, tmp_path):
    path = str(tmp_path / "csv")
    given = [("plain", "1"), ('two\nlines "and"\n\nmore', "2"), ("x", "3"), ("last\nline", "4\n5")] * 50
    S.write_csv(spark.createDataFrame(given, "input string, output string").coalesce(1), path, packed=True)
    got = S.read_csv_split(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(given)
    whole = plan(got).split("Union")[1]  # records of one batch come straight from the reading task
    assert "MapInArrow" in whole
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("1", "3"):  # records cross the borders of batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert sorted(map(tuple, S.read_csv_split(spark, path).collect())) == sorted(given)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


# -- vocabulary ----------------------------------------------------------------------------
def test_encode_and_decode_repeated_and_missing_keys(spark):
    rows = [(1, "b a b"), (2, None), (None, "a"), (3, "a zz"), (3, "c a"), (4, "")]
    docs = spark.createDataFrame(rows, "k int, text string")
    vocab = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12)], "token string, token_id long")
    coded = P.encode(docs, "k", X.words(F.col("text")), vocab)
    got = sorted(((r.k, r.ids) for r in coded.collect()), key=str)
    assert got == sorted([(1, [11, 10, 11]), (2, []), (None, []), (3, [10, 12, 10]), (3, [10, 12, 10]), (4, [])], key=str)
    single = spark.createDataFrame([(1, [11, 10, 99, 11]), (2, None), (5, [])], "k int, ids array<long>")
    assert {(r.k, r.text) for r in P.decode(single, "k", vocab).collect()} == {(1, "b a b"), (2, ""), (5, "")}


def test_words_of_a_block_meet_the_vocabulary_once(spark):
    docs = spark.range(200).select("id", F.lit("common words in every text").alias("text"))
    vocab = P.vocabulary(docs, X.words(F.col("text")))
    coded = P.encode(docs, "id", X.words(F.col("text")), vocab)
    assert "FlatMapCoGroupsInArrow" in plan(coded) and "collect_list" not in plan(coded)
    assert {tuple(r.ids) for r in coded.collect()} == {tuple(coded.first().ids)}


# -- whole runs ----------------------------------------------------------------------------
def test_lines_are_checked_once_before_the_split(spark, tmp_path, monkeypatch):
    made = []
    real = lifecycle_queries.materialize
    monkeypatch.setattr(lifecycle_queries, "materialize", lambda df, name: made.append(df.columns) or real(df, name))
    record = '{\\"medicines\\":[],\\"diseases\\":[],\\"symptoms\\":[],\\"tests\\":[],\\"instructions\\":[]}'
    lines = [f'{{"input":"case {i % 20}","output":"{record}"}}' for i in range(40)] + ["broken"]

    class Given:
        def lines(self):
            return self.spark.createDataFrame([(x,) for x in lines], "line string")

    given = Given()
    given.spark = spark
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    got = registry.QUERIES["jsonl_to_splits"](given).collect()
    assert made == [["accepted", "id", "hash", "ids"]]
    assert len(got) == 20 and sum(r.split == "val" for r in got) == 2


def test_hashed_split_equals_the_split_by_id(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    plain = {r.k for r in P.split_exact(rows, "k").filter("split = 'val'").collect()}
    hashed = rows.withColumn("h", P.split_hash(F.col("k")))
    assert plain == {r.k for r in P.split_exact(hashed, "h", hashed=True).filter("split = 'val'").collect()} and len(plain) == 100


def test_reassembly_reads_its_lines_twice_not_four_times(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [("f", 0, "a"), ("f", 1, "b}"), ("f", 2, " "), ("f", 3, "c"), ("g", 0, "tail"), (None, 0, "d}"), ("h", 0, "x}"), ("h", 1, "y}"), ("h", 2, "z")]
    spark.createDataFrame(rows, "file string, line_no int, line string").write.parquet(path)
    got = C.reassemble(spark.read.parquet(path), F.col("line_no"))
    assert plan(got).split("== Initial Plan ==")[-1].count("FileScan") == 2
    assert {tuple(r) for r in got.collect()} == {("f", 0, "a b}"), ("h", 0, "x}"), ("h", 1, "y}")}
