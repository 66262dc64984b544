"""Steps whose driver memory, time or disk grew faster than their input."""

import json

from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import arrays as A
from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.operators import preferences as P
from pairloom.plans import all_queries, clean_queries, registry  # noqa: F401  (fills the registry)
from pairloom.plans.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- ranks ---------------------------------------------------------------------------------
def test_ranked_losses_are_not_broadcast(spark):
    rows = spark.range(0, 20_000, 1, 4).select(
        "id", *[(-(F.col("id") * p % 7 + 1) / 8).alias(c) for p, c in zip((1, 3, 5, 2), P.COLUMNS)]
    )
    out = P.mixed_loss(rows, {"aot": 0.3, "aot_pair": 0.2}, key="id")
    assert out.filter("loss is not null").count() == 20_000
    out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    assert not [line for line in final.splitlines() if "BroadcastHashJoin" in line and "__rank" in line]
    assert "SortMergeJoin" in final


# -- JSON checks ---------------------------------------------------------------------------
def given(spark):
    class Given(Tables):
        def __getattr__(self, name):
            return {"lineitem": items, "part": parts}[name]

    items = spark.createDataFrame(
        [(k, 1, 1 + (k or 0) % 2, n, 2.0, "A", '"') for k, n in ((1, 2), (7, 1), (13, -1), (22, 3), (19, 4), (17, 5), (None, 2), (3, None))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
    )
    parts = spark.createDataFrame([(1, 'a"b\\', "t\n", None)], "p_partkey long, p_name string, p_type string, p_brand string")
    return Given(spark, "")


def test_texts_are_built_once_before_their_checks(spark):
    spark.conf.set(J.REPEATED_KEYS, "true")
    for name in ("batch_rejects", "validate_rows", "accept_line", "batch_validity", "keys_exact", "explode_records"):
        checks = [line for line in plan(registry.QUERIES[name](given(spark))).splitlines() if "parseJson" in line]
        assert checks and not [line for line in checks if "l_suppkey" in line], name  # no check holds what builds its text


def test_texts_equal_to_json_of_their_structs(spark):
    rows = {r.record_no: r for r in given(spark).pairs().collect()}
    name = "a\"b\\cillin "
    medicine = lambda i, days: {"name": f"{name}{i}", "dosage": "2 mg", "frequency": "twice daily", "duration": f"{days} days", "route": "oral", "timing": '"'}
    whole = {"medicines": [medicine(i, 2) for i in (1, 2, 3)], "diseases": ["t\n"], "symptoms": [None],
             "tests": [{"name": "test 2", "timing": "fasting"}], "instructions": ["A"]}
    text = lambda x: json.dumps(x, separators=(",", ":"))
    assert rows[1].output == text(whole) + " AAA"
    assert rows[7].output == text({"medicines": [medicine(i, 1) for i in (1, 2)], "diseases": ["t\n"], "tests": whole["tests"]}) + " AAA"
    assert rows[22].output == text(whole | {"medicines": [medicine(1, 3)], "tests": [{"name": "test 1", "timing": "fasting"}]})[:-1] + " AAA"
    assert json.loads(rows[13].output[:-4])["medicines"] == [{k: v for k, v in medicine(i, -1).items() if k != "timing"} for i in (1, 0)]
    assert "medicines" not in json.loads(rows[3].output[:-4]) and rows[3].input is None
    assert json.loads(rows[None].output[:-4])["instructions"] == ["A"]


def test_strict_check_of_cut_objects(spark):
    spark.conf.set(J.REPEATED_KEYS, "true")
    cases = [('{"a":1}', True), (' \t{"a":1}\r\n', True), ('{"a":1', False), ('{"a":1}\x0b', False), ('{"a":1},2', False), ('"{"', True),
             ("{", False), ("[1]", True), ("7", True), ("", False), ('{"a":[}', False), ('{"a":1}}', False)]
    df = spark.createDataFrame(cases, "t string, ok boolean")
    assert df.select("t", "ok", J.is_json(F.col("t")).alias("got")).filter("got <> ok").collect() == []
    typed = df.select("t", J.typed(F.col("t"), schemas.PRESCRIPTION).alias("r")).filter("r is not null")
    assert {r.t for r in typed.collect()} == {'{"a":1}', ' \t{"a":1}\r\n'}


def test_sink_result_parses_a_record_once(spark, monkeypatch):
    spark.conf.set(J.REPEATED_KEYS, "true")
    seen = []

    class Stop(Exception):
        pass

    def caught(results, path):
        seen.append(plan(results))
        raise Stop

    monkeypatch.setattr(clean_queries.S, "write_results", caught)
    t = given(spark)
    t.__dict__["events"] = spark.createDataFrame([(1, "view", 2.0)], "user_id long, event_type string, value double")
    try:
        registry.QUERIES["sink_result"](t)
    except Stop:
        pass
    assert len(seen) == 1 and seen[0].count("parseJson") == 1


def test_accepting_a_line_is_compiled(spark):
    spark.conf.set(J.REPEATED_KEYS, "true")
    from pairloom.operators import validation as V

    keys = dict.fromkeys(schemas.RECORD_KEYS, [])
    line = lambda record, **more: json.dumps({"input": "i", "output": record, **more})
    whole = json.dumps(keys)
    blank = " "
    cases = [
        (line(whole), True), (line(whole + " AAA"), True), (line(f"\x1f{whole}{blank}"), True), (line(f"{blank}{whole} AAA AAA"), True),
        (line(whole[:-1] + ', "tests": 1}'), True), (line(json.dumps(keys | {"x": 1})), False), (line(whole + "}"), False),
        (line(whole + whole), False), (line(whole[:-1]), False), (line(whole) + "]", False), (line(whole)[:-1], False), (line("[]"), False),
        (line(whole, input=None), True), (line(whole, input={"a": 1}), True), (json.dumps({"output": whole}), False), (line(3), False), (None, False), ("", False),
    ]
    out = V.accept(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "n int, line string"))
    rows = sorted(out.collect())
    assert [r.accepted for r in rows] == [ok for _, ok in cases]
    assert [r.input for r in rows if r.accepted] == ["i"] * 5 + ["null", '{"a":1}']
    assert rows[2].output == whole + " AAA" and rows[3].output == f"{blank}{whole} AAA AAA" and rows[5].output is None
    assert "lambda" not in plan(out)


def test_landing_does_not_sort_its_rows(spark, tmp_path):
    spark.conf.set(J.REPEATED_KEYS, "true")
    from pairloom.streaming import landing as S

    lines = [json.dumps({"input": "i", "output": json.dumps(dict.fromkeys(schemas.RECORD_KEYS, []))}), "x"] * 20
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("line string").parquet(str(tmp_path / "in")).withColumn("batch", F.lit(1))
    seen, accept = [], S.V.accept
    S.V.accept = lambda frame: seen.append(frame.sparkSession.conf.get(S.BOTH_OPEN)) or accept(frame)
    try:
        S.validate_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    finally:
        S.V.accept = accept
    assert seen == ["2"] and spark.conf.get(S.BOTH_OPEN, "0") == "0"
    assert {(r.accepted, r["count"]) for r in S.read_checked(spark, str(tmp_path / "out")).groupBy("accepted").count().collect()} == {(True, 20), (False, 20)}
