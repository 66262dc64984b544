"""Training-set preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import text as X
from pairloom.operators import packing as K
from pairloom.operators import prep as P
from pairloom.plans.registry import q6, query, r6


def joined(e: str) -> str:
    return f"coalesce(array_to_string({e}, ','), '')"


def quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


ANSWER = "CASE WHEN output LIKE '%AAA' THEN output ELSE trim(output) || ' AAA' END"


@query(
    "format_prompt",
    f"""SELECT row_id, {quoted(P.HEAD)} || input || {quoted(P.MIDDLE)} || ({ANSWER}) || {quoted(P.TAIL)} AS text,
          {quoted(P.HEAD)} || input || {quoted(P.MIDDLE)} AS request FROM pairs""",
    ("pairs",),
)
def _(t):
    return t.pairs().select(
        "row_id",
        P.format_example(F.col("input"), F.col("output")).alias("text"),
        P.format_request(F.col("input")).alias("request"),
    )


@query(
    "chat_render",
    """SELECT conv_id, string_agg('<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END
          || chr(10) || text || '<end_of_turn>' || chr(10), '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id""",
)
def _(t):
    return P.render_chat(t.conversations)


@query(
    "split_exact",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || event_id)) <= ceil(0.1::DOUBLE * count(*) OVER ())
          THEN 'val' ELSE 'train' END AS split FROM events""",
)
def _(t):
    return P.split_exact(t.events.select("event_id"), "event_id")


@query(
    "split_ordered",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= floor(0.9::DOUBLE * count(*) OVER ())
          THEN 'train' ELSE 'val' END AS split FROM events""",
)
def _(t):
    return P.split_ordered(t.events.select("event_id"), "event_id")


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
VOCAB = f"""words AS (SELECT doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM documents),
        vocab AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS token_id FROM words GROUP BY token)"""


@query("vocabulary", f"WITH {VOCAB} SELECT token, n, token_id FROM vocab")
def _(t):
    return P.vocabulary(t.spread("documents", "doc_id"), X.words(F.col("text")))


@query(
    "tokenize_vocab",
    f"""WITH {VOCAB}, e AS (SELECT doc_id, string_agg(token_id::VARCHAR, ',' ORDER BY pos) AS ids FROM words JOIN vocab USING (token) GROUP BY doc_id)
        SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN e USING (doc_id)""",
)
def _(t):
    words = X.words(F.col("text"))
    out = P.encode(t.documents, "doc_id", words, P.vocabulary(t.spread("documents", "doc_id"), words))
    return out.select("doc_id", A.joined(F.col("ids")).alias("ids"))


@query("decode_ids", f"SELECT doc_id, array_to_string({WORDS}, ' ') AS text FROM documents")
def _(t):
    words = X.words(F.col("text"))
    vocab = P.vocabulary(t.spread("documents", "doc_id"), words)
    return P.decode(P.encode(t.documents, "doc_id", words, vocab), "doc_id", vocab)


@query(
    "tokenize_custom",
    """SELECT row_id, array_to_string(list_transform(string_split(input, ' '), lambda w: length(w)), ',') AS ids FROM pairs""",
    ("pairs",),
)
def _(t):
    def load():
        return lambda texts: [[len(w) for w in text.split(" ")] for text in texts]

    tokenize = P.tokenize_with(load)
    return t.pairs().select("row_id", tokenize(F.col("input")).alias("ids")).select("row_id", A.joined(F.col("ids")).alias("ids"))


@query(
    "pad_truncate",
    f"""SELECT row_id, {joined('list_resize(ids[1:1024], 1024, 0)')} AS input_ids,
          {joined('list_transform(range(1, 1025), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END)')} AS attention_mask FROM tokens""",
    ("tokens",),
)
def _(t):
    ids = F.col("ids")
    return t.tokens().select(
        "row_id",
        A.joined(A.pad_right(ids, 1024, 0)).alias("input_ids"),
        A.joined(A.attention_mask(ids, 1024)).alias("attention_mask"),
    )


@query(
    "truncate_modes",
    f"""WITH w AS (SELECT row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM tokens),
        m AS (SELECT *, id IN (3719, 3105) AS kept FROM w),
        r AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY i DESC) AS back,
                count(*) FILTER (WHERE kept) OVER (PARTITION BY row_id) AS n_kept FROM m),
        p AS (SELECT row_id, string_agg(id::VARCHAR, ',' ORDER BY i) AS keep_protected FROM r WHERE kept OR back <= 64 - n_kept GROUP BY row_id)
        SELECT row_id, {joined('ids[1:64]')} AS keep_start, {joined('ids[greatest(len(ids) - 63, 1):]')} AS keep_end,
          coalesce(keep_protected, '') AS keep_protected FROM tokens LEFT JOIN p USING (row_id)""",
    ("tokens",),
)
def _(t):
    ids = F.col("ids")
    return t.tokens().select(
        "row_id",
        A.joined(A.truncate(ids, 64, "keep_start")).alias("keep_start"),
        A.joined(A.truncate(ids, 64, "keep_end")).alias("keep_end"),
        A.joined(A.last_n_keeping(ids, 64, [3719, 3105])).alias("keep_protected"),
    )


@query(
    "truncate_pair_budget",
    f"""WITH a AS (SELECT *, greatest(len(chosen), len(rejected)) AS longer FROM pair_tokens),
        b AS (SELECT row_id, chosen, rejected, longer, CASE WHEN len(prompt) + longer > 128 THEN prompt[greatest(len(prompt) - 15, 1):] ELSE prompt END AS prompt FROM a)
        SELECT row_id, {joined('prompt')} AS prompt,
          {joined('CASE WHEN len(prompt) + longer > 128 THEN chosen[1:112] ELSE chosen END')} AS chosen,
          {joined('CASE WHEN len(prompt) + longer > 128 THEN rejected[1:112] ELSE rejected END')} AS rejected FROM b""",
    ("pair_tokens",),
)
def _(t):
    out = P.truncate_pair(t.pair_tokens(), 128, 16)
    return out.select("row_id", *[A.joined(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(
    "bos_eos",
    f"""SELECT row_id, {joined('CASE WHEN prompt[1] = 3719 THEN prompt ELSE list_prepend(3719, prompt) END')} AS prompt,
          {joined('CASE WHEN chosen[-1] = 3107 THEN chosen ELSE list_append(chosen, 3107) END')} AS chosen FROM pair_tokens""",
    ("pair_tokens",),
)
def _(t):
    return t.pair_tokens().select(
        "row_id",
        A.joined(A.add_bos(F.col("prompt"), 3719)).alias("prompt"),
        A.joined(A.add_eos(F.col("chosen"), 3107)).alias("chosen"),
    )


@query(
    "prompt_mask_labels",
    f"""SELECT row_id, {joined('list_concat(list_transform(prompt, lambda x: -100), chosen)')} AS labels,
          {joined('list_transform(chosen, lambda x: CASE WHEN x = 3107 THEN -100 ELSE x END)')} AS pad_labels,
          {joined('list_transform(chosen, lambda x, i: CASE WHEN i > 16 THEN -100 ELSE x END)')} AS attended FROM pair_tokens""",
    ("pair_tokens",),
)
def _(t):
    p, c = F.col("prompt"), F.col("chosen")
    mask = F.transform(c, lambda x, i: (i < 16).cast("int"))
    return t.pair_tokens().select(
        "row_id",
        A.joined(A.prompt_labels(p, c)).alias("labels"),
        A.joined(A.pad_labels(c, 3107)).alias("pad_labels"),
        A.joined(A.attention_labels(c, mask)).alias("attended"),
    )


@query(
    "completion_mask",
    f"""SELECT row_id, {joined('list_concat(list_transform(prompt, lambda x: 0), list_transform(chosen, lambda x: 1))')} AS mask FROM pair_tokens""",
    ("pair_tokens",),
)
def _(t):
    return t.pair_tokens().select("row_id", A.joined(A.completion_mask(F.col("prompt"), F.col("chosen"))).alias("mask"))


@query(
    "assistant_mask",
    f"""SELECT conv_id, string_agg(repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, len({WORDS})), '' ORDER BY turn) AS mask
        FROM conversations GROUP BY conv_id""",
)
def _(t):
    """Per-token mask of a conversation: 1 over the words of assistant turns."""
    from pairloom.functions import ordered

    bit = F.when(F.col("role") == "assistant", F.lit("1")).otherwise(F.lit("0"))
    turns = t.conversations.select("conv_id", "turn", F.repeat(bit, F.size(X.words(F.col("text")))).alias("bits"))
    return ordered.concat_ordered(turns, ["conv_id"], F.floor(F.col("turn") / 4096), ["turn"], "bits", "", "mask")


STEPS = "[chosen, rejected]"


@query(
    "stepwise_labels",
    f"""SELECT row_id, {joined('list_concat(chosen, [7], rejected, [7])')} AS ids,
          {joined('list_concat(list_transform(chosen, lambda x: -100), [row_id % 2], list_transform(rejected, lambda x: -100), [1 - row_id % 2])')} AS labels,
          {joined('list_concat(list_transform(chosen, lambda x: -100), [-100], list_transform(rejected, lambda x: -100), [1 - row_id % 2])')} AS last_only
        FROM pair_tokens""",
    ("pair_tokens",),
)
def _(t):
    steps = F.array("chosen", "rejected")
    labels = F.array(F.col("row_id") % 2 == 1, F.col("row_id") % 2 == 0)
    return t.pair_tokens().select(
        "row_id",
        A.joined(A.stepwise_ids(steps, [7])).alias("ids"),
        A.joined(A.stepwise_labels(steps, labels, [7])).alias("labels"),
        A.joined(A.stepwise_labels(steps, labels, [7], last_step_only=True)).alias("last_only"),
    )


@query(
    "pad_helpers",
    f"""WITH p AS (SELECT row_id, list_concat(list_transform(range(0, row_id % 5), lambda i: 0), prompt, chosen, [0, 0]) AS ids,
                     len(chosen) + 2 AS n FROM pair_tokens)
        SELECT row_id, len(list_filter(ids[1:len(ids) - n], lambda x: x = 0))::BIGINT AS left_pads,
          {joined('list_concat(list_filter(ids, lambda x: x <> 0), list_filter(ids, lambda x: x = 0))')} AS packed,
          {joined('list_transform(ids, lambda x, i: CASE WHEN i - 1 >= 4 - row_id % 5 AND x <> 0 THEN 1 ELSE 0 END)')} AS mask FROM p""",
    ("pair_tokens",),
)
def _(t):
    pads = F.array_repeat(F.lit(0), (F.col("row_id") % 5).cast("int"))
    rows = t.pair_tokens().select(
        "row_id", F.concat(pads, "prompt", "chosen", F.array(F.lit(0), F.lit(0))).alias("ids"), (F.size("chosen") + 2).alias("n")
    )
    left = F.size(F.filter(A.first_n(F.col("ids"), F.size("ids") - F.col("n")), lambda x: x == 0))
    return rows.select(
        "row_id",
        left.alias("left_pads"),
        A.joined(A.pads_to_right(F.col("ids"), 0)).alias("packed"),
        A.joined(A.shifted_mask(F.col("ids"), F.col("row_id") % 5, F.lit(4), 0)).alias("mask"),
    )


@query(
    "pack_wrapped",
    """WITH w AS (SELECT row_id // 1000 AS batch, row_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM tokens),
       p AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY row_id, i) - 1 AS pos FROM w)
       SELECT batch, pos // 256 AS pack, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM p GROUP BY batch, pos // 256""",
    ("tokens",),
)
def _(t):
    return K.pack_wrapped(t.tokens(), "row_id", 256).select("batch", "pack", A.joined(F.col("ids")).alias("ids"))


@query(
    "pack_bfd",
    """WITH RECURSIVE b AS (SELECT row_id, ids, (row_number() OVER (ORDER BY row_id) - 1) // 1000 AS batch FROM tokens),
       pieces AS (SELECT batch, row_id, piece, ids[piece * 256 + 1 : piece * 256 + 256] AS part
         FROM (SELECT *, unnest(range((len(ids) + 255) // 256)) AS piece FROM b)),
       items AS MATERIALIZED (SELECT *, len(part) AS n, row_number() OVER (PARTITION BY batch ORDER BY len(part) DESC, row_id, piece) AS k FROM pieces),
       fill(batch, k, pack, room) AS (
         SELECT DISTINCT batch, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM items
         UNION ALL
         SELECT batch, k, pack, CASE WHEN pack = len(room) THEN list_append(room, 256 - n)
             ELSE list_concat(list_append(room[1 : pack], room[pack + 1] - n), room[pack + 2 :]) END
         FROM (SELECT f.batch, i.k, i.n, f.room, coalesce(list_position(f.room, list_min(list_filter(f.room, lambda r: r >= i.n))) - 1, len(f.room)) AS pack
               FROM fill f JOIN items i ON i.batch = f.batch AND i.k = f.k + 1))
       SELECT batch, pack, string_agg(array_to_string(part, ','), ',' ORDER BY row_id, piece) AS ids
       FROM fill JOIN items USING (batch, k) GROUP BY batch, pack""",
    ("tokens",),
)
def _(t):
    return K.pack_best_fit(t.tokens(), "row_id", 256).select("batch", "pack", A.joined(F.col("ids")).alias("ids"))


PREFIX = """(SELECT row_id, a, b, coalesce(nullif(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')),
              lambda z: coalesce(z[1] = z[2], false)), false), 0), length(a) + 1) - 1 AS n FROM
            (SELECT row_id, prompt || ' ' || chosen AS a, prompt || ' ' || rejected AS b FROM preferences))"""


@query(
    "extract_prompt",
    f"SELECT row_id, left(a, n) AS prompt, substring(a, n + 1) AS chosen, substring(b, n + 1) AS rejected FROM {PREFIX}",
    ("preferences",),
)
def _(t):
    whole = t.preferences().select(
        "row_id", F.concat("prompt", F.lit(" "), "chosen").alias("chosen"), F.concat("prompt", F.lit(" "), "rejected").alias("rejected")
    )
    return P.extract_prompt(whole).select("row_id", "prompt", "chosen", "rejected")


@query(
    "unpair",
    """SELECT row_id, prompt, chosen AS completion, true AS label FROM preferences
       UNION ALL SELECT row_id, prompt, rejected, false FROM preferences""",
    ("preferences",),
)
def _(t):
    return P.unpair(t.preferences())


MISMATCH = """WITH r AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS b FROM unpaired),
       i AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY row_id) AS i, count(*) OVER (PARTITION BY b) AS n FROM r)"""


@query(
    "kl_mismatch",
    f"""{MISMATCH} SELECT x.row_id, x.prompt, y.row_id AS kl_row_id, y.completion AS kl_completion
        FROM i x JOIN i y ON x.b = y.b AND y.i = x.n + 1 - x.i""",
    ("unpaired",),
)
def _(t):
    out = P.mismatched_pairs(t.unpaired(), "row_id", 8)
    return out.select("row_id", "prompt", "kl_row_id", "kl_completion")


@query(
    "kl_rotate",
    f"""{MISMATCH} SELECT x.row_id, y.row_id AS kl_row_id FROM i x JOIN i y ON x.b = y.b AND y.i = CASE WHEN x.i = 1 THEN x.n ELSE x.i - 1 END""",
    ("unpaired",),
)
def _(t):
    return P.mismatched_pairs(t.unpaired(), "row_id", 8, mode="rotate").select("row_id", "kl_row_id")


def hashed(t):
    """The unpaired rows under ids that are neither numbers nor dense."""
    return t.unpaired().withColumn("row_id", F.md5(F.col("row_id").cast("string")))


MISMATCH_HASHED = MISMATCH.replace("FROM unpaired", "FROM (SELECT * REPLACE (md5(row_id::VARCHAR) AS row_id) FROM unpaired)")


@query(
    "kl_mismatch_hashed",
    f"""{MISMATCH_HASHED} SELECT x.row_id, y.row_id AS kl_row_id, y.completion AS kl_completion
        FROM i x JOIN i y ON x.b = y.b AND y.i = x.n + 1 - x.i""",
    ("unpaired",),
)
def _(t):
    return P.mismatched_pairs(hashed(t), "row_id", 8).select("row_id", "kl_row_id", "kl_completion")


@query(
    "kl_rotate_hashed",
    f"""{MISMATCH_HASHED} SELECT x.row_id, y.row_id AS kl_row_id FROM i x JOIN i y ON x.b = y.b AND y.i = CASE WHEN x.i = 1 THEN x.n ELSE x.i - 1 END""",
    ("unpaired",),
)
def _(t):
    return P.mismatched_pairs(hashed(t), "row_id", 8, mode="rotate").select("row_id", "kl_row_id")


@query(
    "concat_columns",
    "SELECT doc_id, lang, source, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id)",
)
def _(t):
    return P.concat_columns(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query(
    "union_batches",
    "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark",
)
def _(t):
    return P.concat_rows(
        [t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("id"), "text")]
    )


@query(
    "balance_weights",
    f"""WITH c AS (SELECT greatest(count(*) FILTER (WHERE label), 1) AS d, count(*) AS n FROM unpaired),
        b AS (SELECT d AS num_desirable, greatest(n - d, 1) AS num_undesirable FROM c),
        w AS (SELECT *, round(num_undesirable / num_desirable, 2) AS desirable_low, round(num_undesirable / num_desirable * 1.33::DOUBLE, 2) AS desirable_high,
              round(num_desirable / num_undesirable / 1.33::DOUBLE, 2) AS undesirable_low, round(num_desirable / num_undesirable, 2) AS undesirable_high FROM b)
        SELECT *, num_desirable = num_undesirable OR 1 BETWEEN desirable_low AND desirable_high OR 1 BETWEEN undesirable_low AND undesirable_high AS balanced FROM w""",
    ("unpaired",),
)
def _(t):
    return P.class_balance(t.unpaired())


@query(
    "sample_rows",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events),
       d AS (SELECT 1 + ('0x' || substring(md5('42:' || i), 1, 13))::BIGINT % (SELECT count(*) FROM events) AS rank FROM range(1, 513) x(i))
       SELECT event_id, row_number() OVER (PARTITION BY rank) AS draw FROM r JOIN d USING (rank)""",
)
def _(t):
    return P.sample_with_replacement(t.events.select("event_id"), "event_id", 512)


@query(
    "sample_rows_hashed",
    """WITH r AS (SELECT md5(event_id::VARCHAR) AS id, row_number() OVER (ORDER BY md5(event_id::VARCHAR)) AS rank FROM events),
       d AS (SELECT 1 + ('0x' || substring(md5('42:' || i), 1, 13))::BIGINT % (SELECT count(*) FROM events) AS rank FROM range(1, 513) x(i))
       SELECT id, row_number() OVER (PARTITION BY rank) AS draw FROM r JOIN d USING (rank)""",
)
def _(t):
    return P.sample_with_replacement(t.events.select(F.md5(F.col("event_id").cast("string")).alias("id")), "id", 512)


@query(
    "sample_distinct",
    "SELECT event_id FROM events ORDER BY md5('42:' || event_id) LIMIT 512",
)
def _(t):
    return P.sample_exact(t.events.select("event_id"), "event_id", 512)


@query(
    "repeat_prompts",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id)) - 1 AS rank, count(*) OVER () AS n FROM events),
       g AS (SELECT *, rank // 7 AS g, least(7, n - rank // 7 * 7) AS width FROM r)
       SELECT event_id, repeat_no, copy_no, g * 7 * 2 * 4 + (repeat_no * width + rank - g * 7) * 4 + copy_no AS position
       FROM g, range(0, 2) a(repeat_no), range(0, 4) b(copy_no)""",
)
def _(t):
    return P.repeat_prompts(t.events.select("event_id"), "event_id", copies=4, batch=7, repeats=2)


@query(
    "seeded_shuffle",
    "SELECT event_id, event_type, row_number() OVER (ORDER BY md5('42:' || event_id)) - 1 AS position FROM events",
)
def _(t):
    return P.seeded_shuffle(t.events.select("event_id", "event_type"), "event_id")


@query(
    "eos_mask",
    f"""WITH a AS (SELECT row_id, ids, coalesce(list_position(ids, 3105), 0) AS place FROM tokens),
        k AS (SELECT row_id, ids, place > 0 AS terminated, CASE WHEN place = 0 THEN len(ids) ELSE place END AS n FROM a)
        SELECT row_id, {joined('list_resize(list_transform(ids[1:n], lambda x: 1), len(ids), 0)')} AS mask,
          {joined('list_resize(ids[1:n], len(ids), 0)')} AS cut, terminated,
          {joined('list_resize(list_transform(CASE WHEN terminated THEN ids[1:n] ELSE []::BIGINT[] END, lambda x: 1), len(ids), 0)')} AS strict FROM k""",
    ("tokens",),
)
def _(t):
    ids = F.col("ids")
    return t.tokens().select(
        "row_id",
        A.joined(A.mask_after_eos(ids, 3105)).alias("mask"),
        A.joined(A.cut_after_eos(ids, 3105, 0)).alias("cut"),
        F.array_contains(ids, 3105).alias("terminated"),
        A.joined(A.drop_unterminated(A.mask_after_eos(ids, 3105), ids, 3105)).alias("strict"),
    )
