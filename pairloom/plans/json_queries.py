"""JSON recovery and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import arrays as A
from pairloom.functions import jsonx as J
from pairloom.functions import text as X
from pairloom.functions.arrays import let
from pairloom.operators import validation as V
from pairloom.plans.clean_queries import lists_sql, shown_lists
from pairloom.plans.registry import q6, query, r6

KEYS = "['diseases','instructions','medicines','symptoms','tests']"
MED_KEYS = "['dosage','duration','frequency','name','route','timing']"


def json_or_null(e: str) -> str:
    return f"CASE WHEN json_valid({e}) THEN {e} END"


FENCES = r"regexp_replace(text, '```(?:json)?\s*|\s*```', '', 'g')"
OUTER = r"nullif(regexp_extract({}, '\{{[\s\S]*\}}'), '')"


ANY_FENCE = r"regexp_replace({}, '```[a-z]*\s*|\s*```', '', 'g')"
TAGGED = "CASE WHEN chunk_no % 3 = 0 THEN replace(text, '```json', '```python') WHEN chunk_no % 3 = 1 THEN replace(text, '```json', '```') ELSE text END"


def tagged(text="text"):
    """Fences with another tag or none in two thirds of the rows."""
    n = F.col("chunk_no") % 3
    other = lambda tag: F.replace(F.col(text), F.lit("```json"), F.lit(tag))
    return F.when(n == 0, other("```python")).when(n == 1, other("```")).otherwise(F.col(text))


@query("fence_strip", f"SELECT conv_id, chunk_no, {ANY_FENCE.format(TAGGED)} AS text FROM model_output", ("model_output",))
def _(t):
    return t.model_output().withColumn("text", J.strip_fences(tagged()))


@query("json_outer", f"SELECT conv_id, chunk_no, {OUTER.format('text')} AS found FROM model_output", ("model_output",))
def _(t):
    return t.model_output().select("conv_id", "chunk_no", J.outer_object(F.col("text")).alias("found"))


def balanced_sql(source: str) -> str:
    """CTEs after which ``e`` has start and finish of the first balanced span of each text in ``source``."""
    return f"""c AS (SELECT conv_id, chunk_no, text, unnest(range(1, length(text) + 1)) AS i FROM {source}),
       d AS (SELECT *, CASE substring(text, i, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS v FROM c),
       p AS (SELECT *, sum(v) OVER (PARTITION BY chunk_no ORDER BY i) AS depth FROM d WHERE v <> 0),
       s AS (SELECT *, min(depth) OVER (PARTITION BY chunk_no ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p),
       b AS (SELECT chunk_no, min(i) AS start, min_by(depth, i) AS depth FROM s WHERE v = 1 AND later < depth GROUP BY chunk_no),
       e AS (SELECT b.chunk_no, b.start, min(p.i) AS finish FROM b JOIN p ON p.chunk_no = b.chunk_no AND p.i > b.start AND p.depth < b.depth GROUP BY ALL)"""


SPAN = "CASE WHEN finish IS NOT NULL THEN substring(text, start, finish - start + 1) END"


@query(
    "json_balanced",
    f"WITH {balanced_sql('model_output')} SELECT conv_id, chunk_no, {SPAN} AS found FROM model_output LEFT JOIN e USING (chunk_no)",
    ("model_output",),
)
def _(t):
    return t.model_output().select("conv_id", "chunk_no", J.balanced_object(F.col("text")).alias("found"))


# Every third output loses the comma between its two medicines, every fifth gains a brace.
# The second repair of the former repeats the key "dosage"; its last value counts.
BROKEN = (
    "CASE WHEN chunk_no % 3 = 0 THEN replace(found, '\"},{', '\"} {') WHEN chunk_no % 5 = 0 "
    "THEN replace(found, '\"diseases\"', '{\"diseases\"') ELSE found END"
)


@query(
    "json_repair",
    f"""WITH x AS (SELECT conv_id, chunk_no, {OUTER.format('text')} AS found FROM model_output),
        b AS (SELECT conv_id, chunk_no, {BROKEN} AS broken FROM x),
        r AS (SELECT *, replace(broken, ',{{', ',') AS once FROM b),
        w AS (SELECT *, regexp_replace(once, '\\}}\\s*\\{{', ',', 'g') AS twice FROM r),
        f AS (SELECT conv_id, chunk_no, CASE WHEN json_valid(broken) THEN broken WHEN json_valid(once) THEN once
            WHEN json_valid(twice) THEN twice END AS repaired FROM w)
        SELECT conv_id, chunk_no, repaired, (SELECT max_by(j.value->>'$', j.id) FROM json_each(repaired, '$.medicines[0]') j
            WHERE j.key = 'dosage') AS dosage FROM f""",
    ("model_output",),
)
def _(t):
    found, n = J.outer_object(F.col("text")), F.col("chunk_no")
    broken = (
        F.when(n % 3 == 0, F.replace(found, F.lit('"},{'), F.lit('"} {')))
        .when(n % 5 == 0, F.replace(found, F.lit('"diseases"'), F.lit('{"diseases"')))
        .otherwise(found)
    )
    rows = t.model_output().select("conv_id", "chunk_no", broken.alias("broken"))
    rows = rows.select("conv_id", "chunk_no", J.repair_object(F.col("broken")).alias("repaired"))
    dosage = F.try_variant_get(J.strict_variant(F.col("repaired")), "$[0].medicines[0].dosage", "string")
    return rows.withColumn("dosage", dosage)


FALLBACK = f"coalesce({json_or_null(OUTER.format('text'))}, {json_or_null(OUTER.format(FENCES))})"


@query("json_fallback", f"SELECT conv_id, chunk_no, {FALLBACK} AS found FROM model_output", ("model_output",))
def _(t):
    return t.model_output().select("conv_id", "chunk_no", J.recover_object(F.col("text")).alias("found"))


@query(
    "json_typed",
    f"""SELECT conv_id, chunk_no, json_array_length(rec, '$.medicines')::BIGINT AS n_medicines, {lists_sql()},
            CASE WHEN rec IS NULL THEN 'Invalid JSON output' END AS error, CASE WHEN rec IS NULL THEN text END AS raw
        FROM (SELECT *, {FALLBACK} AS rec FROM model_output)""",
    ("model_output",),
)
def _(t):
    rows = t.model_output().withColumn("found", F.coalesce(J.recover_object(F.col("text")), F.col("text")))
    out = V.typed_or_error(rows, "found", schemas.PRESCRIPTION)
    medicines = F.col("parsed")["medicines"]
    return out.select(
        "conv_id", "chunk_no", F.when(medicines.isNotNull(), F.size(medicines)).alias("n_medicines"), *shown_lists(F.col("parsed")),
        "error", F.when(F.col("error").isNotNull(), F.col("text")).alias("raw"),
    )


RECORD = "replace(output, ' AAA', '')"


@query(
    "keys_exact",
    f"""SELECT row_id, coalesce(list_sort(json_keys({json_or_null(RECORD)})) = {KEYS}, false) AS exact FROM pairs""",
    ("pairs",),
)
def _(t):
    exact = let(X.strip_marker(F.col("output")), lambda r: J.keys_are(r, schemas.RECORD_KEYS))
    return A.once(t.pairs(), "output").select("row_id", exact.alias("exact"))


def med_exact(record: str) -> str:
    meds = f"(json_extract({json_or_null(record)}, '$.medicines[*]'))"
    return f"coalesce(len(list_filter({meds}, lambda m: list_sort(json_keys(m)) <> {MED_KEYS})) = 0, false)"


@query("med_keys_exact", f"SELECT row_id, {med_exact(RECORD)} AS exact FROM pairs", ("pairs",))
def _(t):
    record = X.strip_marker(F.col("output"))
    exact = let(
        record,
        lambda r: let(J.strict_variant(r), lambda v: J.is_strict(v, r) & J.items_have_keys(v, "medicines", schemas.MEDICINE_KEYS)),
    )
    return A.once(t.pairs(), "output").select("row_id", exact.alias("exact"))


OUTPUT = "json_extract_string(" + json_or_null("line") + ", '$.output')"
LINE_RECORD = "replace(out, ' AAA', '')"
CHECKED = f"""SELECT *, CASE WHEN NOT json_valid(line) THEN 'bad_line' WHEN out IS NULL THEN 'no_output'
            WHEN NOT json_valid({LINE_RECORD}) THEN 'bad_output'
            WHEN NOT coalesce(list_sort(json_keys({json_or_null(LINE_RECORD)})) = {KEYS}, false) THEN 'wrong_keys'
            WHEN NOT {med_exact(LINE_RECORD)} THEN 'wrong_medicine_keys' END AS error
          FROM (SELECT *, {OUTPUT} AS out FROM lines)"""


@query("validate_rows", f"SELECT row_id, batch, error FROM ({CHECKED})", ("lines",))
def _(t):
    return V.with_errors(t.lines()).select("row_id", "batch", "error")


ACCEPTED = "(error IS NULL OR error = 'wrong_medicine_keys')"


@query(
    "accept_line",
    f"""SELECT row_id, {ACCEPTED} AS accepted, CASE WHEN {ACCEPTED} THEN json_extract_string({json_or_null('line')}, '$.input') END AS input,
          CASE WHEN {ACCEPTED} THEN (CASE WHEN out LIKE '%AAA' THEN out ELSE trim(out) || ' AAA' END) END AS output FROM ({CHECKED})""",
    ("lines",),
)
def _(t):
    return V.accept(t.lines()).select("row_id", "accepted", "input", "output")


@query(
    "batch_validity",
    f"""SELECT batch, count(*) FILTER (WHERE {ACCEPTED}) AS valid, count(*) AS total,
          count(*) FILTER (WHERE NOT {ACCEPTED}) AS invalid FROM ({CHECKED}) GROUP BY batch""",
    ("lines",),
)
def _(t):
    return V.batch_report(V.accept(t.lines()))


@query("batch_rejects", f"SELECT batch, row_id FROM ({CHECKED}) WHERE NOT {ACCEPTED}", ("lines",))
def _(t):
    return V.accept(t.lines()).filter(~F.col("accepted")).select("batch", "row_id")


FOUND = f"SELECT conv_id, chunk_no, {FALLBACK} AS found FROM model_output"
MEDS = "SELECT conv_id, chunk_no, unnest(json_extract(found, '$.medicines[*]')) AS m, generate_subscripts(json_extract(found, '$.medicines[*]'), 1) - 1 AS pos FROM (" + FOUND + ")"


def parsed(t):
    return t.model_output().select(
        "conv_id", "chunk_no", J.typed(J.recover_object(F.col("text")), schemas.PRESCRIPTION).alias("record")
    )


@query(
    "fill_unspecified",
    "SELECT conv_id, chunk_no, pos, "
    + ", ".join(f"coalesce(m->>'$.{k}', 'unspecified') AS {k}" for k in schemas.MEDICINE_KEYS)
    + f" FROM ({MEDS})",
    ("model_output",),
)
def _(t):
    filled = parsed(t).select("conv_id", "chunk_no", V.fill_unspecified(F.col("record")).alias("record"))
    rows = A.unnest(filled, ["conv_id", "chunk_no"], F.col("record")["medicines"], "m", "pos")
    return rows.select("conv_id", "chunk_no", "pos", "m.*")


@query(
    "field_coverage",
    " UNION ALL ".join(
        f"SELECT '{k}' AS field, {q6(f'''count(m->>'$.{k}') / count(*)''')} AS rate FROM ({MEDS})" for k in schemas.MEDICINE_KEYS
    ),
    ("model_output",),
)
def _(t):
    return V.field_coverage(parsed(t)).select("field", r6(F.col("rate")).alias("rate"))


ENTITIES = f"""SELECT conv_id, chunk_no, 'medicine' AS kind, pos, m->>'$.name' AS name, m->>'$.dosage' AS dosage,
        m->>'$.frequency' AS frequency, m->>'$.duration' AS duration, m->>'$.route' AS route, m->>'$.timing' AS timing FROM ({MEDS})
      UNION ALL SELECT conv_id, chunk_no, 'test', generate_subscripts(x, 1) - 1, unnest(x)->>'$.name', NULL, NULL, NULL, NULL, unnest(x)->>'$.timing'
        FROM (SELECT conv_id, chunk_no, json_extract(found, '$.tests[*]') AS x FROM ({FOUND}))
      UNION ALL SELECT conv_id, chunk_no, 'disease', generate_subscripts(x, 1) - 1, unnest(x)->>'$', NULL, NULL, NULL, NULL, NULL
        FROM (SELECT conv_id, chunk_no, json_extract(found, '$.diseases[*]') AS x FROM ({FOUND}))"""


FULL = "SELECT row_id, replace(output, ' AAA', '') AS found FROM pairs"


def list_sql(kind: str, name: str, fields: list[str] | None) -> str:
    """Rows of one list of the records in ``full``; a list of texts has no fields."""
    shown = [f"x->>'$.{f}'" if f in (fields or []) else "NULL" for f in schemas.MEDICINE_KEYS[1:]]
    named = "x->>'$.name'" if fields else "x->>'$'"
    columns = ", ".join(f"{e} AS {f}" for e, f in zip(shown, schemas.MEDICINE_KEYS[1:]))
    return f"""SELECT row_id, '{kind}' AS kind, pos, {named} AS name, {columns} FROM
      (SELECT row_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT row_id, json_extract(found, '$.{name}[*]') AS l FROM ({FULL}) WHERE json_valid(found)))"""


FIVE_LISTS = {"medicine": ("medicines", schemas.MEDICINE_KEYS), "test": ("tests", schemas.TEST_KEYS), "disease": ("diseases", None), "symptom": ("symptoms", None), "instruction": ("instructions", None)}


@query("explode_records", " UNION ALL ".join(list_sql(k, *v) for k, v in FIVE_LISTS.items()), ("pairs",))
def _(t):
    rows = A.once(t.pairs(), "output").select("row_id", J.typed(X.strip_marker(F.col("output")), schemas.PRESCRIPTION).alias("record"))
    return V.explode_entities(rows, ["row_id"])


@query("explode_entities", ENTITIES, ("model_output",))
def _(t):
    return V.explode_entities(parsed(t), ["conv_id", "chunk_no"])
