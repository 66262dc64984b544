"""Quality rules per document and across the documents of a host. Built-in expressions only.

Words are runs of characters other than 09-0D and 20. Rules of one document: word and symbol counts, repeated
lines, words in repeated 3-word windows; a document fails them with fewer than ``min_words`` words or with more
than half of its words in repeated windows. Rules across documents: every line is normalised (lower case, digits
to 0, blanks collapsed, trimmed) and hashed; per host the distinct documents with that line are counted; lines in
more than ``line_docs`` documents and more than ``line_percent`` percent of the host's documents are boilerplate.
A document that keeps less than ``keep_percent`` percent of its line characters without them is depleted and
rejected.

Documents of one text count once, so exact copies, however many, make none of their lines boilerplate; near copies
are documents of their own. A null host is the host ''. Null and empty texts have no words and fail. Repeated rows are
judged one by one. An empty table gives an empty result. Windows and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import apart, save

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body != "", F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    """Whole text with each line's digits, case and blanks evened out; line breaks stay."""
    even = F.regexp_replace(F.lower(text), "[1-9]", "0")
    return F.regexp_replace(even, r"[\t\x0B\f\r][\t\x0B\f\r ]*| [\t\x0B\f\r ]+", " ")


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``__repeat``: words in 3-word windows found at least twice, from ``__words``.

    A window is first a 64-bit hash whose low bits give way to its position, so that one primitive sort
    brings equal windows together; the few that meet are checked by their whole hash.
    """
    df = df.withColumn("__bits", F.length(F.bin(F.size("__words"))).cast("int"))
    df = df.withColumn(
        "__keys",
        F.expr(
            """sort_array(slice(transform(__words, (w, i) -> shiftleft(shiftright(
               xxhash64(w, get(__words, i + 1), get(__words, i + 2)), __bits), __bits) | i), 1, greatest(size(__words) - 2, 0)))"""
        ),
    )
    df = df.withColumn(
        "__met",
        F.expr(
            """filter(__keys, (k, i) -> shiftright(k, __bits) <=> shiftright(get(__keys, i - 1), __bits)
                      or shiftright(k, __bits) <=> shiftright(get(__keys, i + 1), __bits))"""
        ),
    )
    df = df.withColumn("__at", F.expr("transform(__met, k -> cast(k & (shiftleft(1L, __bits) - 1) as int))"))
    df = df.withColumn(
        "__full",
        F.expr(
            """sort_array(transform(__at, p -> struct(
               xxhash64(get(__words, p), get(__words, p + 1), get(__words, p + 2)) as h, p as p)))"""
        ),
    )
    df = df.withColumn(
        "__twice",
        F.expr(
            """sort_array(transform(filter(__full, (x, i) -> x.h <=> get(__full, i - 1).h or x.h <=> get(__full, i + 1).h),
                                     x -> x.p))"""
        ),
    )
    covered = "aggregate(transform(__twice, (p, i) -> least(3, coalesce(p - get(__twice, i - 1), 3))), 0L, (a, x) -> a + x)"
    out = df.withColumn("__repeat", F.expr(covered))
    return out.drop("__bits", "__keys", "__met", "__at", "__full", "__twice")


def digests(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """One small row per document: base measures and the hashes and lengths of its normalised lines."""
    df = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).alias("__id"),
        F.xxhash64(text).alias("__th"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    )
    df = df.withColumn("__words", words(F.col("__text")))
    df = with_repeats(df)
    df = df.withColumn("__raw", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn(
        "__lines",
        F.filter(
            F.transform(F.split(normalised(F.col("__text")), "\n"), lambda x: F.struct(F.length(F.trim(x)).alias("c"), F.trim(x).alias("t"))),
            lambda x: x["c"] > 0,
        ),
    )
    return df.select(
        "__row",
        "__id",
        "__th",
        "__host",
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("__raw") - F.size(F.array_distinct("__raw"))).cast("bigint").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.transform("__lines", lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), x["c"].alias("c"))).alias("__lines"),
    )


def boilerplate(lines: DataFrame, line_docs: int, line_percent: int) -> DataFrame:
    """(__host, h) of the lines above the limits. ``lines``: __host, __th, h, one row per line."""
    seen = lines.groupBy("__host", "h", "__th").agg(F.lit(1).alias("one"))
    counts = seen.groupBy("__host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs)
    hosts = lines.groupBy("__host", "__th").agg(F.lit(1).alias("one")).groupBy("__host").agg(F.count("*").alias("all"))
    return counts.join(hosts, "__host").filter(F.col("n") * 100 > F.col("all") * line_percent).select("__host", "h")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    line_docs: int = 20,
    line_percent: int = 10,
    keep_percent: int = 30,
) -> DataFrame:
    """One row per document: text hash ``__th``, measures, ``kept`` and the hashes of its lines to remove, ``__drop``."""
    rows = save(digests(docs, id_col, text, host), "digests")
    lines = rows.select("__row", "__host", "__th", F.inline("__lines"))
    removed = save(boilerplate(lines, line_docs, line_percent), "boilerplate")
    lost = lines.join(removed, ["__host", "h"]).groupBy("__row")
    lost = lost.agg(F.sum("c").cast("bigint").alias("n_removed_chars"), F.collect_set("h").alias("__drop"))
    out = rows.join(lost, "__row", "left").withColumn("n_removed_chars", F.coalesce("n_removed_chars", F.lit(0)))
    out = out.withColumn("n_line_chars", F.expr("aggregate(__lines, 0L, (a, x) -> a + x.c)"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_line_chars") - F.col("n_removed_chars")) * 100 < F.col("n_line_chars") * keep_percent
    out = out.withColumn("base_failed", failed).withColumn("depleted", depleted)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_chars", "n_removed_chars", "base_failed", "depleted"]
    return out.select("__th", "__drop", F.col("__id").alias(id_col), *names, (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per document with its measures and ``kept`` (see the module's text)."""
    return judge(docs, **options).drop("__th", "__drop")


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The kept documents without their boilerplate lines; all columns stay, ``n_chars`` follows if present.

    The small verdicts meet the texts by id and text hash, so the texts move once.
    """
    names, docs = docs.columns, apart(docs, "__id", "__th", "__drop")
    good = judge(docs, id_col=id_col, text=text, **options).filter("kept")
    good = good.groupBy(F.col(id_col).alias("__id"), "__th").agg(F.first("__drop").alias("__drop"))
    same = docs[id_col].eqNullSafe(good["__id"]) & (F.xxhash64(docs[text]) == good["__th"])
    kept = docs.join(good, same)
    line_hash = lambda x: F.xxhash64(F.trim(normalised(x)))
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("__drop", line_hash(x)))
    out = kept.withColumn(text, F.when(F.col("__drop").isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns]).toDF(*names)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)),
t AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, w, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 THEN 1 ELSE 0 END AS f FROM t),
c AS (SELECT *, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM f),
m AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(c)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
r AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
l AS (SELECT doc_id, host, th, trim(regexp_replace(translate(lower(l), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), ' {2,}', ' ', 'g'), ' ') AS l
    FROM (SELECT doc_id, host, md5(text) AS th, unnest(string_split(text, chr(10))) AS l FROM d)),
n AS (SELECT doc_id, host, th, l, length(l) AS c FROM l WHERE l <> ''),
s AS (SELECT host, l, count(DISTINCT th) AS n FROM n GROUP BY host, l),
h AS (SELECT host, count(DISTINCT th) AS a FROM n GROUP BY host),
b AS (SELECT host, l FROM s JOIN h USING (host) WHERE n > 20 AND n * 100 > a * 10),
x AS (SELECT n.doc_id, sum(c)::BIGINT AS n_line_chars, coalesce(sum(CASE WHEN b.l IS NOT NULL THEN c END), 0)::BIGINT AS n_removed_chars
    FROM n LEFT JOIN b ON n.host = b.host AND n.l = b.l GROUP BY n.doc_id),
v AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_line_chars, 0)::BIGINT AS n_line_chars, coalesce(n_removed_chars, 0)::BIGINT AS n_removed_chars
    FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (n_line_chars - n_removed_chars) * 100 < n_line_chars * 30 AS depleted,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_line_chars - n_removed_chars) * 100 < n_line_chars * 30) AS kept
FROM v
"""
