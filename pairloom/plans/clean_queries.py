"""Sources, sinks and row cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import arrays as A
from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.operators import cleaning as C
from pairloom.plans.registry import query
from pairloom.functions.scratch import scratch_dir
from pairloom.sources import pairs as S

PY = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^{PY}+', ''), '{PY}+$', '')"


# -- sources and sinks -------------------------------------------------------------------
@query(
    "src_csv",
    """SELECT CASE WHEN record_no % 3 = 0 THEN input || chr(10) || chr(10) || 'say "twice", then' || chr(10) || '"stop"' ELSE input END AS input, output FROM pairs""",
    ("pairs",),
)
def _(t):
    path = scratch_dir(t.spark, "csv")
    broken = F.concat("input", F.lit('\n\nsay "twice", then\n"stop"'))
    rows = t.pairs().select(F.when(F.col("record_no") % 3 == 0, broken).otherwise(F.col("input")).alias("input"), "output")
    S.write_csv(rows, path, packed=True)
    return S.read_csv_split(t.spark, path)


@query("src_jsonl", "SELECT input, output, NULL::VARCHAR AS corrupt FROM pairs", ("pairs",))
def _(t):
    path = scratch_dir(t.spark, "jsonl")
    S.write_jsonl(t.pairs().select("input", "output"), path, packed=True)
    return S.read_jsonl(t.spark, path).select("input", "output", F.col(S.CORRUPT).alias("corrupt"))


@query("src_text", "SELECT line FROM raw_lines", ("raw_lines",))
def _(t):
    path = scratch_dir(t.spark, "text")
    t.documents.select("text").write.text(path)
    return S.read_lines(t.spark, path).select("line")


@query(
    "src_tokens",
    """SELECT row_id, CASE WHEN row_id % 10 = 0 THEN 'val' ELSE 'train' END AS split,
              array_to_string(ids, ',') AS ids FROM tokens""",
    ("tokens",),
)
def _(t):
    path = scratch_dir(t.spark, "tokens")
    split = F.when(F.col("row_id") % 10 == 0, F.lit("val")).otherwise(F.lit("train"))
    S.write_splits(t.tokens().select("row_id", "ids", split.alias("split")), path)
    return S.read_splits(t.spark, path).select("row_id", "split", A.joined(F.col("ids")).alias("ids"))


EVENT_STAGES = ("purchase", "click", "view", "signup", "error")
ITEM = "list_transform(coalesce(json_extract(rec, '$.{list}[*]'), []), lambda m: concat_ws('/', {fields}))"


def items_sql(name: str, fields: list[str]) -> str:
    each = ", ".join(f"coalesce(m->>'$.{f}', '')" for f in fields) if fields else "m->>'$'"
    return f"CASE WHEN rec IS NULL THEN NULL ELSE array_to_string({ITEM.format(list=name, fields=each)}, '|') END AS {name}"


def shown_lists(record) -> list:
    """The five lists of a record as text; NULL where there is no record."""
    text = lambda fields: lambda m: F.concat_ws("/", *[F.coalesce(m[f], F.lit("")) for f in fields])
    whole = lambda items: F.array_join(F.when(record.isNotNull(), F.coalesce(items, F.array())), "|")
    named = [("medicines", schemas.MEDICINE_KEYS), ("tests", schemas.TEST_KEYS)]
    out = [whole(F.transform(record[n], text(fields))).alias(n) for n, fields in named]
    return out + [whole(record[n]).alias(n) for n in ("diseases", "symptoms", "instructions")]


def lists_sql() -> str:
    """The same of ``rec`` in SQL."""
    fields = {"medicines": schemas.MEDICINE_KEYS, "tests": schemas.TEST_KEYS, "diseases": [], "symptoms": [], "instructions": []}
    return ", ".join(items_sql(n, f) for n, f in fields.items())


@query(
    "sink_result",
    f"""WITH e AS (SELECT user_id, {", ".join(f"sum(value) FILTER (WHERE event_type = '{s}') AS {s}" for s in EVENT_STAGES)} FROM events GROUP BY user_id),
        r AS (SELECT record_no, arg_min(out, row_id) AS rec FROM (SELECT record_no, row_id, replace(output, ' AAA', '') AS out FROM pairs) WHERE json_valid(out) GROUP BY record_no)
        SELECT 'recording ' || user_id AS english_text, 'नोंद' AS marathi_text, {", ".join(f"(round({s}, 6) + 0.0) AS {s}" for s in EVENT_STAGES)},
          (round({" + ".join(f"coalesce({s}, 0)" for s in EVENT_STAGES)}, 6) + 0.0) AS total,
          {lists_sql()}
        FROM e LEFT JOIN r ON user_id = record_no""",
    ("pairs",),
)
def _(t):
    stages = t.events.groupBy("user_id").pivot("event_type", list(EVENT_STAGES)).agg(F.sum("value"))
    pairs = A.once(t.pairs(), "output").select("record_no", "row_id", J.typed(X.strip_marker(F.col("output")), schemas.PRESCRIPTION).alias("record"))
    # A filter on the record would be pushed down with its parse, which then runs twice; rows without one have no place here.
    place = F.when(F.col("record").isNotNull(), F.col("row_id"))
    found = pairs.groupBy("record_no").agg(F.min_by("record", place).alias("entities"))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in EVENT_STAGES), F.lit(0.0))
    flat = stages.join(found, F.col("user_id") == F.col("record_no"), "left").select(
        *EVENT_STAGES, total.alias("total"), F.concat(F.lit("recording "), F.col("user_id").cast("string")).alias("english_text"),
        F.lit("नोंद").alias("marathi_text"), "entities",
    )
    path = scratch_dir(t.spark, "results")
    S.write_results(S.run_results(flat, (*EVENT_STAGES, "total")), path)
    back = S.read_results(t.spark, path)
    return back.select(
        F.col("transcripts")["english"].alias("english_text"),
        F.col("transcripts")["marathi"].alias("marathi_text"),
        *[(F.round(F.col("timings")[s], 6) + F.lit(0.0)).alias(s) for s in (*EVENT_STAGES, "total")],
        *shown_lists(F.col("entities")),
    )


@query(
    "manifest",
    """SELECT lang, count(*) AS num_rows, sum(strlen(source) + strlen(text))::BIGINT AS num_bytes,
              'doc_id:bigint, text:string, lang:string, source:string, n_chars:bigint' AS features
       FROM documents GROUP BY lang""",
)
def _(t):
    return S.manifest(t.documents, "lang", ["source", "text"])


# -- row cleaning ------------------------------------------------------------------------
@query(
    "blank_drop",
    f"""SELECT file, line_no, line FROM (SELECT file, line_no, {sql_strip('line')} AS line FROM raw_lines)
        WHERE length(line) > 0""",
    ("raw_lines",),
)
def _(t):
    return C.nonblank_lines(t.raw_lines())


@query(
    "record_reassemble",
    f"""WITH kept AS (SELECT file, line_no, {sql_strip('line')} AS line FROM raw_lines),
        numbered AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '%.' THEN 1 ELSE 0 END) OVER
                (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_no
            FROM kept WHERE length(line) > 0)
        SELECT file, record_no, string_agg(line, ' ' ORDER BY line_no) AS text FROM numbered
        GROUP BY file, record_no HAVING bool_or(line LIKE '%.')""",
    ("raw_lines",),
)
def _(t):
    return C.reassemble(t.raw_lines(), F.floor(F.col("line_no") / 4096), ends=(".",))


JSON_LINES = """SELECT record_no AS file, row_id || md5(input || output) AS row_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
          FROM (SELECT *, string_split('"' || input || chr(10) || replace(replace(output, ' AAA', '"'), '},', '} ,' || chr(10)), chr(10)) AS parts FROM pairs)"""


@query(
    "record_reassemble_json",
    f"""WITH raw AS ({JSON_LINES}), kept AS (SELECT file, row_id, line_no, {sql_strip('line')} AS line FROM raw),
        numbered AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '%}}' OR line LIKE '%}}"' THEN 1 ELSE 0 END) OVER
                (PARTITION BY file ORDER BY row_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_no
            FROM kept WHERE length(line) > 0)
        SELECT file, record_no, string_agg(line, ' ' ORDER BY row_id, line_no) AS text FROM numbered
        GROUP BY file, record_no HAVING bool_or(line LIKE '%}}' OR line LIKE '%}}"')""",
    ("pairs",),
)
def _(t):
    text = F.concat(F.lit('"'), "input", F.lit("\n"), F.replace(F.replace("output", F.lit(" AAA"), F.lit('"')), F.lit("},"), F.lit("} ,\n")))
    key = F.concat("row_id", F.md5(F.concat("input", "output")))  # rows of one id differ in their text
    # A file's pairs are brought together before their texts are built. With the key computed once a pair, both readings of
    # the lines need the same columns, so these are written once for both.
    pairs = A.bound(t.pairs(together=True), "row_id", key)
    lines = pairs.select(F.col("record_no").alias("file"), "row_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return C.reassemble(lines, F.lit(0), order=("row_id", "line_no"))


RECORDS = "'  \"' || input || '\" ' || output || '\" '"


@query(
    "record_split",
    f"""SELECT row_id, trim(trim(left(text, place - 1)), '"') AS input, trim(trim(substring(text, place)), '"') AS output
        FROM (SELECT *, instr(text, '{{"medicines') AS place FROM (SELECT row_id, {RECORDS} AS text FROM pairs))
        WHERE place > 0""",
    ("pairs",),
)
def _(t):
    text = F.concat(F.lit('  "'), "input", F.lit('" '), "output", F.lit('" '))
    return C.split_record(t.pairs().select("row_id", text.alias("text")))


@query(
    "dropna_pairs",
    """SELECT gen_no, r1, r2 FROM scored WHERE r1 IS NOT NULL AND r2 IS NOT NULL""",
    ("scored",),
)
def _(t):
    return C.drop_missing(t.scored().select("gen_no", "r1", "r2"), ("r1", "r2"))


@query(
    "json_valid_filter",
    """SELECT row_id, replace(output, ' AAA', '') AS output, json_valid(replace(output, ' AAA', '')) AS valid FROM pairs""",
    ("pairs",),
)
def _(t):
    return C.mark_json(t.pairs().select("row_id", X.strip_marker(F.col("output")).alias("output")))


def text_query(name, sql, column):
    """A query that maps one text of every pair."""

    @query(name, f"SELECT row_id, {sql} AS text FROM pairs", ("pairs",))
    def _(t):
        return t.pairs().select("row_id", column().alias("text"))


text_query("stop_strip", "replace(output, ' AAA', '')", lambda: X.strip_marker(F.col("output")))
text_query(
    "stop_append",
    "CASE WHEN output LIKE '%AAA' THEN output ELSE trim(output) || ' AAA' END",
    lambda: X.append_marker(F.col("output")),
)
text_query("stop_cut", "trim(split_part(output, 'AAA', 1))", lambda: X.cut_at_marker(F.col("output")))
text_query(
    "turn_token_strip",
    "chr(10) || input || chr(10)",
    lambda: X.strip_turn_tokens(F.concat(F.lit(X.USER_TURN + "\n"), "input", F.lit("\n" + X.MODEL_TURN))),
)
text_query(
    "prefix_strip",
    "CASE WHEN record_no % 2 = 0 THEN trim(output) ELSE output END",
    lambda: X.drop_prefix(
        F.when(F.col("record_no") % 2 == 0, F.concat("input", F.lit(" "), "output")).otherwise(F.col("output")),
        F.col("input"),
    ),
)
text_query(
    "pad_text_strip",
    "'Take' || substring(input, 5)",
    lambda: X.strip_leading(F.concat(F.repeat(F.lit("<pad>"), (F.col("record_no") % 4).cast("int")), "input"), "<pad>"),
)
text_query(
    "token_collapse",
    "'<img>' || input || '<img>'",
    lambda: X.collapse(
        F.concat(F.repeat(F.lit("<img>"), (1 + F.col("record_no") % 4).cast("int")), "input", F.lit("<img><img>")), "<img>"
    ),
)


@query(
    "after_cue",
    "SELECT conv_id, chunk_no, trim(split_part(text, 'JSON:', -1)) AS text FROM model_output",
    ("model_output",),
)
def _(t):
    return t.model_output().withColumn("text", X.after_cue(F.col("text"), "JSON:"))


@query(
    "policy_vs_reference",
    """SELECT row_id, prompt, trim(chosen) AS policy, trim(rejected) AS reference FROM preferences""",
    ("preferences",),
)
def _(t):
    """Side-by-side table: prompt, and the two answers without the echoed prompt."""
    p = t.preferences().select(
        "row_id", "prompt", F.concat("prompt", F.lit(" "), "chosen").alias("a"), F.concat("prompt", F.lit(" "), "rejected").alias("b")
    )
    return p.select(
        "row_id",
        "prompt",
        X.drop_prefix(F.col("a"), F.col("prompt")).alias("policy"),
        X.drop_prefix(F.col("b"), F.col("prompt")).alias("reference"),
    )


@query(
    "short_chunk_drop",
    f"SELECT file, line_no, line FROM raw_lines WHERE length({sql_strip('line')}) >= 10",
    ("raw_lines",),
)
def _(t):
    return C.long_enough(t.raw_lines(), "line")


@query(
    "dedupe_rows",
    """SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(t):
    return C.dedupe(t.documents.select("doc_id", "text", "lang"), ["text"], ["doc_id"])


@query("project_cols", "SELECT event_id, value FROM events")
def _(t):
    return t.events.select("event_id", "value")


@query(
    "pair_length_filter",
    "SELECT row_id, len(chosen) AS n_chosen, len(rejected) AS n_rejected FROM pair_tokens WHERE len(chosen) <= 512 AND len(rejected) <= 512",
    ("pair_tokens",),
)
def _(t):
    return C.within_length(t.pair_tokens(), ["chosen", "rejected"], 512).select(
        "row_id", F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected")
    )


@query(
    "label_filter",
    "SELECT row_id, prompt, label, CASE WHEN label THEN 'desirable' ELSE 'undesirable' END AS part FROM unpaired",
    ("unpaired",),
)
def _(t):
    good, bad = C.by_label(t.unpaired().select("row_id", "prompt", "label"))
    return good.withColumn("part", F.lit("desirable")).unionByName(bad.withColumn("part", F.lit("undesirable")))


@query(
    "preview_topn",
    "SELECT doc_id, left(text, 200) AS head, right(text, 200) AS tail FROM documents ORDER BY doc_id LIMIT 5",
)
def _(t):
    return C.preview(t.documents, ["doc_id"], "text")
