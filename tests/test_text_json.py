import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import entities as E
from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.operators import cleaning as C
from pairloom.operators import validation as V
from pairloom.sources import pairs as S


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


def test_markers(spark):
    assert one(spark, "{} AAA", X.strip_marker) == "{}"
    assert one(spark, "{} ", X.append_marker) == "{} AAA"
    assert one(spark, "{} AAA", X.append_marker) == "{} AAA"
    assert one(spark, "x AAA y AAA", X.cut_at_marker) == "x"
    assert one(spark, "a AAA b AAA", X.strip_marker) == "a b"


def test_strip_matches_python(spark):
    for text in ["  x　", "\x1c\ty \x85", " z\n", " ", "", "​q​"]:
        assert one(spark, text, X.strip) == text.strip()


def test_prefix_cue_and_tokens(spark):
    assert one(spark, "a JSON: b JSON: c ", lambda c: X.after_cue(c, "JSON:")) == "c"
    assert one(spark, " none ", lambda c: X.after_cue(c, "JSON:")) == " none "
    assert one(spark, "prompt answer", lambda c: X.drop_prefix(c, F.lit("prompt"))) == "answer"
    assert one(spark, "<pad><pad>x<pad>", lambda c: X.strip_leading(c, "<pad>")) == "x<pad>"
    assert one(spark, "$$a$$$", lambda c: X.collapse(c, "$")) == "$a$"
    assert one(spark, "abcd", lambda c: X.shared_prefix(c, F.lit("abxd"))) == "ab"
    assert one(spark, "abc", lambda c: X.shared_prefix(c, F.lit("abc"))) == "abc"
    assert one(spark, "abc", lambda c: X.shared_prefix(c, F.lit("abcde"))) == "abc"
    assert one(spark, "x", lambda c: X.shared_prefix(c, F.lit("y"))) == ""


def test_reassemble_and_split(spark):
    lines = ["take it", ' {"medicines": [],', "", ' "x": 1}', "no json}", "left over"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no int, line string")
    for rows_per_block in (1, 2, 100):  # records must not depend on the block size
        records = C.reassemble(df, F.floor(F.col("line_no") / rows_per_block))
        texts = [r["text"] for r in records.orderBy("record_no").collect()]
        assert texts == ['take it {"medicines": [], "x": 1}', "no json}"]
    pairs = C.split_record(records).collect()
    assert [(p["input"], p["output"]) for p in pairs] == [("take it", '{"medicines": [], "x": 1}')]


def test_outer_and_balanced(spark):
    text = 'a {"x":{"y":1}} b {"z":2} c'
    assert one(spark, text, J.outer_object) == '{"x":{"y":1}} b {"z":2}'
    assert one(spark, text, J.recover_object) is None
    assert one(spark, text, J.balanced_object) == '{"x":{"y":1}}'
    assert one(spark, "} { {a} {b}", J.balanced_object) == "{a}"
    assert one(spark, "{{", J.balanced_object) is None
    assert one(spark, "none", J.outer_object) is None


def test_balanced_against_brute_force(spark):
    import itertools

    def brute(s):
        for i, c in enumerate(s):
            if c != "{":
                continue
            depth = 0
            for j in range(i, len(s)):
                depth += (s[j] == "{") - (s[j] == "}")
                if depth == 0:
                    return s[i : j + 1]
        return None

    texts = ["".join(p) for n in range(7) for p in itertools.product("{}x", repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", J.balanced_object("v").alias("r")).collect()
    assert all(r["r"] == brute(r["v"]) for r in rows)


def test_json_is_the_whole_text(spark):
    import json

    texts = ['{"a":1}', ' {"a":[1,{"b":null}]} ', "[]", "3", '"x"', "null", "", " ", '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}]', "[1],[2]",
             '{"a":1}],[{"b":2}', '{"a":1', "{'a':1}", '{"a":1,}', "1,2", '{"a":"é\\u00e9"}', "[1,]", "tru", "true false", '{"a":1}}']

    def loads(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    for text in texts:
        assert one(spark, text, J.is_json) == loads(text), text


def test_repair(spark):
    assert one(spark, '{"a":[{"b":1},{"b":2}]}', J.repair_object) == '{"a":[{"b":1},{"b":2}]}'
    assert one(spark, '{"a":1,{"b":2}', J.repair_object) == '{"a":1,"b":2}'
    assert one(spark, '{"a":1} {"b":2}', J.repair_object) == '{"a":1,"b":2}'
    assert one(spark, "{a", J.repair_object) is None
    assert one(spark, '```json\n{"a": "é"}\n```', J.recover_object) == '{"a": "é"}'


def test_last_of_repeated_keys_counts(spark):
    import json

    from pyspark.sql import types as T

    texts = ['{"a":"1","a":"2"}', '{"a":"1","b":"x","a":"3"}', '{"a":{"b":"1"},"a":"5","a":"6"}']
    schema = T.StructType([T.StructField("a", T.StringType())])
    for text in texts:
        want = json.loads(text)
        assert one(spark, text, lambda c: J.text_field(c, "a")) == want["a"]
        assert one(spark, text, lambda c: J.typed(c, schema)["a"]) == want["a"]
        assert one(spark, text, lambda c: J.keys_are(c, sorted(want)))
    broken = '{"m":[{"a":"1","b":"2"} {"a":"3"}]}'
    repaired = one(spark, broken, J.repair_object)
    assert json.loads(repaired) == {"m": [{"a": "3", "b": "2"}]}
    assert one(spark, FULL % SIX.replace('{"name"', '{"name":"z","name"') + "x", lambda c: J.keys_are(c, ["a"])) is False


def test_setting_for_repeated_keys_is_asked_for(spark):
    spark.conf.set(J.REPEATED_KEYS, "false")
    try:
        with pytest.raises(ValueError):
            J.is_json(F.col("x"))
    finally:
        spark.conf.set(J.REPEATED_KEYS, "true")


FULL = '{"medicines":[%s],"diseases":[],"symptoms":[],"tests":[],"instructions":[]}'
SIX = '{"name":"a","dosage":"b","frequency":"c","duration":"d","route":"e","timing":"f"}'
FIVE = '{"name":"a","dosage":"b","frequency":"c","duration":"d","route":"e"}'


def line(output):
    import json

    return json.dumps({"input": "x", "output": output})


def test_first_error(spark):
    cases = {
        line(FULL % SIX + " AAA"): None,
        line(FULL % ""): None,
        line(FULL % FIVE): "wrong_medicine_keys",
        line("[]"): "wrong_keys",
        line("{}"): "wrong_keys",
        line((FULL % SIX)[:-1]): "bad_output",
        '{"input": "x"}': "no_output",
        '{"input": "x", "output": 3}': "no_output",
        "{": "bad_line",
        "[1]": "no_output",
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r["line"]: r["error"] for r in V.with_errors(df).collect()}
    assert got == cases


def test_accept(spark):
    output = line(FULL % SIX)[len('{"input": "x", "output": ') : -1]
    lines = [line(FULL % FIVE), '{"output": "{}"}', line("x"), "[]", '{"output": %s}' % output, '{"input": null, "output": %s}' % output,
             '{"input": {"a": 1}, "output": %s} x' % output, '{"input": {"a": 1}, "output": %s}' % output]
    rows = V.accept(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)).collect()
    assert [r["accepted"] for r in rows] == [True, False, False, False, False, True, False, True]
    assert rows[7]["input"] == '{"a":1}'
    assert rows[0]["output"].endswith("} AAA") and rows[0]["input"] == "x"


def test_good_and_rejected_rows(spark):
    df = spark.createDataFrame([("a", "{}"), ("b", "{"), ("c", None)], "input string, output string")
    good, bad = C.split_by_json(df)
    assert [r["input"] for r in good.collect()] == ["a"]
    assert sorted(r["input"] for r in bad.collect()) == ["b", "c"]
    assert sorted(r["input"] for r in C.drop_missing(df).collect()) == ["a", "b"]


def test_typed_and_fill(spark):
    df = spark.createDataFrame([('{"medicines":[{"name":"a"}]}',), ("[]",), ("{",)], "v string")
    rows = V.typed_or_error(df, "v", schemas.PRESCRIPTION).collect()
    assert rows[0]["error"] is None and rows[0]["parsed"]["medicines"][0]["name"] == "a"
    assert rows[1]["raw"] == "[]" and rows[2]["error"] == "Invalid JSON output"
    filled = V.typed_or_error(df, "v", schemas.PRESCRIPTION).select(V.fill_unspecified(F.col("parsed")).alias("f")).collect()
    assert filled[0]["f"]["medicines"][0]["route"] == "unspecified" and filled[0]["f"]["tests"] == []
    assert filled[2]["f"] is None


def test_entities_match_python(spark):
    import re

    text = "Take Amoxicillin 500 mg twice daily for 5 days, 2.5 ml café Ärzte naïve OD 10 Units"
    for kind, pattern in E.PATTERNS.items():
        assert one(spark, text, lambda c: E.extract(c, kind)) == sorted(set(re.findall(pattern, text, re.I)))


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    rows = [('a "quoted", text\nwith a break', '{"k": "é"} AAA'), ("", None), ("नोंद", "x")]
    df = spark.createDataFrame(rows, "input string, output string")
    S.write_csv(df, str(tmp_path / "csv"))
    back = S.read_csv(spark, str(tmp_path / "csv"))
    assert sorted((r["input"] or "") for r in back.collect()) == sorted(r[0] for r in rows)
    S.write_jsonl(df, str(tmp_path / "jsonl"))
    assert "नोंद" in "".join(p.read_text() for p in (tmp_path / "jsonl").glob("*.json"))
    (tmp_path / "jsonl" / "bad.json").write_text("{oops\n")
    got = S.read_jsonl(spark, str(tmp_path / "jsonl")).cache()
    assert got.filter(F.col(S.CORRUPT).isNotNull()).count() == 1 and got.count() == 4


def test_lines_without_bad_bytes(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_bytes(b"one\xff\r\ntwo\n\nthree\xc3\xa9")
    assert [r["line"] for r in S.read_whole_texts(spark, str(path)).orderBy("line_no").collect()] == ["one", "two", "", "threeé"]
    split = S.read_lines(spark, str(path)).orderBy("block", "line_no").collect()
    assert [r["line"] for r in split] == ["one", "two", "", "threeé"]


def test_records_across_file_splits(spark, tmp_path):
    text = "".join(f'record {i} {{"medicines": [],\n"n": {i}}}\n' for i in range(3000))
    (tmp_path / "big.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = S.read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        records = C.split_record(C.reassemble(lines, F.col("block"), order=("block", "line_no"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r["record_no"], r["input"]) for r in records)
    assert got == [(i, f"record {i}") for i in range(3000)]


def test_fences_with_any_tag(spark):
    from pairloom.functions import jsonx

    df = spark.createDataFrame([("```python\n{}\n```",), ("```json {}```",), ("```{}```",)], "t string")
    assert [r[0] for r in df.select(jsonx.strip_fences(F.col("t"))).collect()] == ["{}"] * 3
