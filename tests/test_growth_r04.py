"""Steps that read, moved or built their rows more often than needed."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.functions import jsonx as J
from pairloom.plans import all_queries, registry  # noqa: F401  (fills the registry)
from pairloom.plans.tables import Tables
from pairloom.sources import pairs as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- CSV -----------------------------------------------------------------------------------
def batches(lines, size, **more):
    rows = [{"file": f, "block": b, "line_no": i, "line": x, **more} for i, (f, b, x) in enumerate(lines)]
    return [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_records_are_joined_across_batches(size):
    lines = [("f", 0, x) for x in ("a,b", '"x', "", 'y ""q""",1', "z,2", '"open', "end")] + [("g", 0, x) for x in (" ", "a,b", "w,3")]
    got = [x for batch in S._records(iter(batches(lines, size))) for x in batch.column("record").to_pylist()]
    assert got == ['"x\n\ny ""q""",1', "z,2", '"open\nend', " ", "w,3"]


@pytest.mark.parametrize("size", [1, 2, 100])
def test_only_records_at_borders_of_blocks_are_pieces(size):
    first = [("f", 0, x) for x in ("a,b", "p,1", '"x', "y")]
    second = [("f", 9, x) for x in ("u", 'v",2', '"k', 'l",3')]
    given = batches(first, size, open=0) + batches(second, size, open=1)
    rows = [r for batch in S._pieces(iter(given)) for r in batch.to_pylist()]
    assert [r["line"] for r in rows if r["whole"]] == ["p,1", '"k\nl",3']
    assert [(r["block"], r["begins"], r["line"]) for r in rows if not r["whole"]] == [(0, True, '"x\ny'), (9, False, 'u\nv",2')]


def test_packed_csv_is_read_once_and_plain_csv_in_blocks(spark, tmp_path):
    given = [("plain", "1"), ('two\nlines "and"\n\nmore', "2"), ("x", None), ("last\nline", "4\n5"), ("r\rs", "6")] * 40
    rows = spark.createDataFrame(given, "input string, output string").coalesce(1)
    S.write_csv(rows, str(tmp_path / "packed"), packed=True)
    S.write_csv(rows, str(tmp_path / "plain"))
    got = S.read_csv_split(spark, str(tmp_path / "packed"))
    scans = [x for x in plan(got).splitlines() if "FileScan text" in x]
    assert len([x for x in scans if "NOT EndsWith(file_path" not in x]) == 1  # what else is scanned leaves out packed files
    same = lambda df: sorted(map(tuple, df.collect()), key=str) == sorted(given, key=str)
    assert same(got)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        assert same(S.read_csv_split(spark, str(tmp_path / "plain")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


# -- pairs ---------------------------------------------------------------------------------
def tables(spark, folder):
    items = [(k, 1 + (k or 0) % 2, 1, n, 2.0, "A", "x\ny") for k, n in ((1, 2), (1, 3), (1, 2), (7, 1), (13, -1), (22, 3), (17, 5), (None, 2), (3, None))]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(items, names).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(1, 'a"b\\', "t\x01", None), (2, "plain", "é", "b")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{folder}/part.parquet")
    return Tables(spark, folder)


def test_pairs_of_a_record_stand_together(spark, tmp_path):
    t = tables(spark, str(tmp_path))
    assert sorted(map(str, t.pairs().collect())) == sorted(map(str, t.pairs(together=True).collect()))
    parts = t.pairs(together=True).select("record_no", F.spark_partition_id().alias("p")).distinct().groupBy("record_no").count()
    assert parts.filter("count > 1").isEmpty()


def test_reassembly_moves_columns_not_texts(spark, tmp_path):
    t = tables(spark, str(tmp_path))
    got = registry.QUERIES["record_reassemble_json"](t)
    dealt = [x for x in plan(got).splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "(file#" in x]  # lines have a file; they stay where they are built
    assert got.count() > 0


def test_quoted_text(spark):
    cases = ["", "plain é", 'a"b', "c\\d", "\x01", "\n", "\x7f", "\u2028", "[x]", None]
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    want = F.when(F.col("t").isNotNull(), F.btrim(F.to_json(F.array("t")), F.lit("[]")))
    assert all(r.a == r.b for r in df.select(J.quoted(F.col("t")).alias("a"), want.alias("b")).collect())
