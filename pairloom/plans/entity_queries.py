"""Entity extraction and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import entities as E
from pairloom.functions import jsonx as J
from pairloom.operators import entities as M
from pairloom.operators import validation as V
from pairloom.operators.inference import apply_model, word_count_stub
from pairloom.plans.clean_queries import shown_lists
from pairloom.plans.json_queries import ENTITIES, FALLBACK, parsed
from pairloom.plans.registry import query


def found_sql(text: str, kind: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, '(?i){E.PATTERNS[kind]}')))"


def listed(kind: str, text: str) -> str:
    return f"array_to_string({found_sql(text, kind)}, '|') AS {kind}"


@query(
    "regex_entities",
    "SELECT row_id, " + ", ".join(listed(k, "input") for k in E.PATTERNS) + " FROM pairs",
    ("pairs",),
)
def _(t):
    rows = t.pairs().select("row_id", E.extract_all(F.col("input")).alias("e"))
    return rows.select("row_id", *[F.array_join(F.col("e")[k], "|").alias(k) for k in E.PATTERNS])


# DuckDB's \b only knows ASCII: both sides see other characters as spaces.
FOLDED = "regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g')"


@query(
    "entities_top10",
    "SELECT doc_id, "
    + ", ".join(
        f"array_to_string({found_sql(FOLDED, k)}[1:10], ', ') || CASE WHEN len({found_sql(FOLDED, k)}) > 10 THEN '...' ELSE '' END AS {k}"
        for k in E.PATTERNS
    )
    + " FROM documents",
)
def _(t):
    text = F.regexp_replace("text", "[^\\x00-\\x7f]", " ")
    rows = t.spread("documents", "doc_id").select("doc_id", text.alias("text"))
    return rows.select("doc_id", *[E.shown(E.extract(F.col("text"), k)).alias(k) for k in E.PATTERNS])


def entities(t):
    return V.explode_entities(parsed(t), ["conv_id", "chunk_no"])


@query(
    "merge_named",
    f"""SELECT conv_id, kind, lower(coalesce(name, '')) AS key, chunk_no, pos, name, dosage, frequency, duration, route, timing
        FROM ({ENTITIES}) WHERE kind <> 'disease'
        QUALIFY row_number() OVER (PARTITION BY conv_id, kind, lower(coalesce(name, '')) ORDER BY chunk_no, pos) = 1""",
    ("model_output",),
)
def _(t):
    return M.merge_named(entities(t))


@query(
    "merge_values",
    f"""SELECT conv_id, name, chunk_no, pos FROM ({ENTITIES}) WHERE kind = 'disease' AND name <> ''
        QUALIFY row_number() OVER (PARTITION BY conv_id, name ORDER BY chunk_no, pos) = 1""",
    ("model_output",),
)
def _(t):
    return M.merge_values(entities(t))


@query(
    "merge_concat",
    f"""SELECT conv_id, kind, chunk_no, pos, name, dosage, frequency, duration, route, timing FROM ({ENTITIES})
        QUALIFY kind <> 'disease' OR chunk_no = min(chunk_no) OVER (PARTITION BY conv_id, kind, name)""",
    ("model_output",),
)
def _(t):
    return M.merge_concat(entities(t))


def kept_sql(kind: str, key: str, fields: list[str]) -> str:
    """First entity of each key with all its fields, as text in order of appearance."""
    text = "concat_ws('/', " + ", ".join(f"coalesce({f}, '')" for f in fields) + ")"
    return f"""(SELECT conv_id, string_agg({text}, '|' ORDER BY chunk_no, pos) AS found
        FROM (SELECT * FROM kept WHERE kind = '{kind}' QUALIFY row_number() OVER (PARTITION BY conv_id, {key} ORDER BY chunk_no, pos) = 1) GROUP BY conv_id)"""


LOWER = "lower(coalesce(name, ''))"


@query(
    "merged_document",
    f"""WITH ents AS ({ENTITIES}), kept AS (SELECT * FROM ents WHERE kind <> 'disease' OR name <> ''),
        c AS (SELECT DISTINCT conv_id FROM kept)
        SELECT c.conv_id, coalesce(m.found, '') AS medicines, coalesce(d.found, '') AS diseases, coalesce(t.found, '') AS tests, '' AS symptoms, '' AS instructions
        FROM c LEFT JOIN {kept_sql('medicine', LOWER, schemas.MEDICINE_KEYS)} m ON m.conv_id = c.conv_id
          LEFT JOIN {kept_sql('test', LOWER, schemas.TEST_KEYS)} t ON t.conv_id = c.conv_id
          LEFT JOIN {kept_sql('disease', 'name', ['name'])} d ON d.conv_id = c.conv_id""",
    ("model_output",),
)
def _(t):
    doc = M.merged_document(entities(t))
    record = F.struct("medicines", "tests", "diseases", "symptoms", "instructions")
    return doc.select("conv_id", *shown_lists(record))


@query(
    "chunk_failures",
    f"""WITH a AS (SELECT (chunk_no // 2) % 150 AS conv_id, chunk_no // 2 AS chunk_no, 1 + chunk_no % 2 AS attempt,
                  {FALLBACK} IS NOT NULL AS ok FROM model_output),
        c AS (SELECT conv_id, chunk_no, coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS used, bool_or(ok) AS ok
              FROM a GROUP BY conv_id, chunk_no)
        SELECT conv_id, count(*) AS chunks, count(*) FILTER (WHERE NOT ok) AS failed, max(used) AS max_attempts,
          sum(used)::BIGINT AS total_attempts FROM c GROUP BY conv_id""",
    ("model_output",),
)
def _(t):
    n = F.col("chunk_no")
    chunk = F.floor(n / 2).cast("bigint")
    tries = t.model_output().select(
        (chunk % 150).alias("conv_id"),
        chunk.alias("chunk_no"),
        (1 + n % 2).alias("attempt"),
        J.recover_object(F.col("text")).isNotNull().alias("ok"),
    )
    return M.chunk_failures(tries)


@query(
    "apply_model",
    """SELECT conv_id, chunk_no, CASE WHEN good THEN '{"words":' || len(string_split(text, ' ')) || '}' END AS result,
          CASE WHEN NOT good THEN 'no result' END AS error, CASE WHEN good THEN 1 ELSE 2 END::BIGINT AS attempts
       FROM (SELECT *, rtrim(text, '`' || chr(10) || ' ') LIKE '%}' AS good FROM model_output)""",
    ("model_output",),
)
def _(t):
    return apply_model(t.model_output(), word_count_stub, "text", ["conv_id", "chunk_no"])
