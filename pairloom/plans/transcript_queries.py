"""Transcripts and speaker labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.operators import speakers as K
from pairloom.operators import transcripts as R
from pairloom.plans.registry import q6, query, r6


@query(
    "transcript_concat",
    """SELECT rec_id, string_agg(trim(text), ' ' ORDER BY start, seg_no) AS transcript FROM segments
       WHERE trim(text) <> '' GROUP BY rec_id""",
    ("segments",),
)
def _(t):
    return R.transcript(t.segments(), ["rec_id"])


@query(
    "transcript_raw",
    """SELECT rec_id, string_agg(text, ' ' ORDER BY start, seg_no) AS transcript FROM segments GROUP BY rec_id""",
    ("segments",),
)
def _(t):
    return R.transcript(t.segments(), ["rec_id"], strip=False)


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(
    "explode_words",
    f"""SELECT doc_id, pos AS word_no, pos * 0.5::DOUBLE AS start, pos * 0.5::DOUBLE + 0.5 AS "end", word FROM
        (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) - 1 AS pos FROM documents)""",
)
def _(t):
    from pairloom.functions.text import words

    timed = F.transform(
        words(F.col("text")),
        lambda w, i: F.struct((i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.5).cast("double").alias("end"), w.alias("word")),
    )
    return R.explode_words(t.spread("documents", "doc_id").select("doc_id", timed.alias("words")), ["doc_id"])


@query(
    "pivot_language",
    """SELECT rec_id, string_agg(trim(text), ' ' ORDER BY start, seg_no) FILTER (WHERE lang = 'en') AS en,
              string_agg(trim(text), ' ' ORDER BY start, seg_no) FILTER (WHERE lang = 'mr') AS mr
       FROM segments GROUP BY rec_id""",
    ("segments",),
)
def _(t):
    return R.by_language(R.transcript(t.segments(), ["rec_id", "lang"]), "rec_id", ["en", "mr"])


@query(
    "window_chunks",
    f"""WITH r AS (SELECT event_id AS rec_id, floor(value * 10 * 100)::BIGINT AS total FROM events),
        a AS (SELECT rec_id, total, unnest(range(0, greatest(1, total - 3000 + 1), 2600)) AS s FROM r),
        b AS (SELECT rec_id, total, s FROM a UNION ALL
              SELECT rec_id, total, greatest(0, total - 3000) FROM (SELECT rec_id, total, max(s) AS m FROM a GROUP BY rec_id, total) WHERE m + 3000 < total)
        SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY s) - 1 AS chunk_no,
          {q6('s / 100::DOUBLE')} AS start, {q6('least(s + 3000, total) / 100::DOUBLE')} AS "end" FROM b""",
)
def _(t):
    rows = t.events.select(F.col("event_id").alias("rec_id"), "value")
    w = R.window_chunks(rows, "rec_id", F.col("value") * 10, 100, 30.0, 4.0)
    return w.select("rec_id", "chunk_no", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"))


@query(
    "window_chunks_fixed",
    f"""WITH a AS (SELECT event_id AS rec_id, unnest(range(0, floor(value * 100)::BIGINT - 300, 150)) AS s FROM events)
        SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY s) - 1 AS chunk_no, {q6('s / 100::DOUBLE')} AS start, {q6('(s + 300) / 100::DOUBLE')} AS "end" FROM a""",
)
def _(t):
    rows = t.events.select(F.col("event_id").alias("rec_id"), "value")
    w = R.window_chunks(rows, "rec_id", F.col("value"), 100, 3.0, 1.5, tail=False)
    return w.select("rec_id", "chunk_no", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"))


@query(
    "frame_times_even",
    f"""WITH r AS (SELECT user_id, max(value) * 6.2831853::DOUBLE AS duration, count(*) AS frames FROM events GROUP BY user_id),
        f AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events)
        SELECT rec_id, frame, {q6('frame * (duration / frames)')} AS start, {q6('frame * (duration / frames) + duration / frames')} AS "end" FROM f JOIN r ON rec_id = user_id""",
)
def _(t):
    frames = t.events.groupBy(F.col("user_id").alias("rec_id")).agg((F.max("value") * 6.2831853).alias("duration"), F.count(F.lit(1)).alias("frames"))
    rows = frames.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)))
    out = R.frame_times_even(rows, "frame", F.col("duration"), F.col("frames"))
    return out.select("rec_id", "frame", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"))


@query(
    "frame_times",
    f"""SELECT event_id AS frame, {q6('event_id * 1.5::DOUBLE')} AS start, {q6('event_id * 1.5::DOUBLE + 3')} AS "end" FROM events""",
)
def _(t):
    return R.frame_times(t.events.select(F.col("event_id").alias("frame")), "frame", 1.5, 3.0)


def rounded(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda x: (round(x * 10000))::BIGINT), ',')"


def shown(vector):
    return A.joined(F.transform(vector, lambda x: F.round(x * 10000, 0).cast("bigint")))


NORMED = "list_transform({v}, lambda x: x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-8))"


@query(
    "l2_normalize",
    f"SELECT rec_id, chunk_no, {rounded(NORMED.format(v='embedding'))} AS vector FROM chunks",
    ("chunks",),
)
def _(t):
    return t.chunks().select("rec_id", "chunk_no", shown(K.l2_normalize(F.col("embedding"))).alias("vector"))


CENTROIDS = f"""means AS (SELECT rec_id, label, list(m ORDER BY pos) AS v FROM
          (SELECT rec_id, label, pos, avg(x) AS m FROM
            (SELECT rec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM chunks)
           GROUP BY rec_id, label, pos) GROUP BY rec_id, label),
        normed AS (SELECT rec_id, label, {NORMED.format(v='v')} AS centroid FROM means)"""


@query(
    "centroids",
    f"WITH {CENTROIDS} SELECT rec_id, label::BIGINT AS label, {rounded('centroid')} AS centroid FROM normed",
    ("chunks",),
)
def _(t):
    return K.centroids(t.chunks(), "rec_id").select("rec_id", "label", shown(F.col("centroid")).alias("centroid"))


@query(
    "reassign_cosine",
    f"""WITH nc AS (SELECT rec_id, chunk_no, label, {NORMED.format(v='embedding')} AS embedding FROM chunks), {CENTROIDS.replace('FROM chunks', 'FROM nc')},
          s AS (SELECT c.rec_id, c.chunk_no, c.label, n.label AS other, list_dot_product(c.embedding, n.centroid) AS sim
            FROM nc c JOIN normed n ON c.rec_id = n.rec_id)
        SELECT rec_id, chunk_no, {q6('sim')} AS similarity, (CASE WHEN sim >= 0.8 THEN other ELSE label END)::BIGINT AS label
        FROM s QUALIFY row_number() OVER (PARTITION BY rec_id, chunk_no ORDER BY sim DESC, other) = 1""",
    ("chunks",),
)
def _(t):
    c = t.chunks().withColumn("embedding", K.l2_normalize(F.col("embedding")))
    out = K.reassign(c, K.centroids(c, "rec_id"), "rec_id", 0.8)
    return out.select("rec_id", "chunk_no", r6(F.col("similarity")).alias("similarity"), "label")


# Ward merges as a recursion whose state is the list of clusters (members, centroid); then silhouettes of 2 to 5 clusters.
GAP = "pow(list_distance(cl[i].c, cl[j].c), 2) * 2 * len(cl[i].m) * len(cl[j].m) / (len(cl[i].m) + len(cl[j].m))"
MEAN = "lambda z: (z[1] * len(cl[best.i].m) + z[2] * len(cl[best.j].m)) / (len(cl[best.i].m) + len(cl[best.j].m))"
WARD = f"""ward(rec_id, cl) AS (
          SELECT rec_id, list({{'m': [chunk_no], 'c': embedding}} ORDER BY chunk_no) FROM chunks GROUP BY rec_id
          UNION ALL
          SELECT rec_id, list_append(list_filter(cl, lambda x, p: p <> best.i AND p <> best.j),
            {{'m': list_concat(cl[best.i].m, cl[best.j].m), 'c': list_transform(list_zip(cl[best.i].c, cl[best.j].c), {MEAN})}})
          FROM (SELECT rec_id, cl, list_min(flatten(list_transform(range(1, len(cl)), lambda i: list_transform(range(i + 1, len(cl) + 1),
            lambda j: {{'d': {GAP}, 'i': i, 'j': j}})))) AS best FROM ward WHERE len(cl) > 2)),
        sets AS (SELECT rec_id, len(cl) AS k, unnest(cl) AS x FROM ward WHERE len(cl) BETWEEN 2 AND 5),
        named AS (SELECT rec_id, k, x.m AS m, row_number() OVER (PARTITION BY rec_id, k ORDER BY list_min(x.m)) - 1 AS label FROM sets),
        held AS MATERIALIZED (SELECT rec_id, k, label, len(m) AS n, unnest(m) AS chunk_no FROM named),
        far AS MATERIALIZED (SELECT a.rec_id, a.chunk_no, b.chunk_no AS other, list_distance(a.embedding, b.embedding) AS d FROM chunks a JOIN chunks b ON a.rec_id = b.rec_id),
        near AS (SELECT h.rec_id, h.k, h.chunk_no, h.n AS own, o.label = h.label AS same, sum(d) / greatest(any_value(o.n) - CASE WHEN o.label = h.label THEN 1 ELSE 0 END, 1) AS mean
          FROM held h JOIN far f ON f.rec_id = h.rec_id AND f.chunk_no = h.chunk_no JOIN held o ON o.rec_id = h.rec_id AND o.k = h.k AND o.chunk_no = f.other
          GROUP BY h.rec_id, h.k, h.chunk_no, h.n, h.label, o.label),
        sides AS (SELECT rec_id, k, chunk_no, own, min(mean) FILTER (WHERE same) AS a, min(mean) FILTER (WHERE NOT same) AS b FROM near GROUP BY ALL),
        fits AS (SELECT rec_id, k, avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS score FROM sides GROUP BY rec_id, k),
        chosen AS (SELECT rec_id, k FROM fits QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, k) = 1)"""


@query("choose_k", f"WITH RECURSIVE {WARD} SELECT rec_id, k FROM chosen", ("chunks",))
def _(t):
    return K.cluster_speakers(t.chunks(), "rec_id").groupBy("rec_id").agg(F.first("k").alias("k"))


@query("cluster_labels", f"WITH RECURSIVE {WARD} SELECT rec_id, chunk_no, label FROM held JOIN chosen USING (rec_id, k)", ("chunks",))
def _(t):
    return K.cluster_speakers(t.chunks(), "rec_id").select("rec_id", "chunk_no", "label")


@query(
    "median_smooth",
    """SELECT rec_id, chunk_no, list_sort(list_concat(around, list_transform(range(0, 3 - len(around)), lambda i: 0)))[2]::BIGINT AS label
       FROM (SELECT rec_id, chunk_no, list(label) OVER (PARTITION BY rec_id ORDER BY chunk_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM chunks)""",
    ("chunks",),
)
def _(t):
    return R.median_smooth(t.chunks(), "rec_id", R.smoothing_kernel(90, 30)).select("rec_id", "chunk_no", "label")


@query(
    "label_segments",
    """WITH c AS (SELECT *, label % 3 AS l, lag(label % 3) OVER (PARTITION BY rec_id ORDER BY chunk_no) AS before,
                 max("end") OVER (PARTITION BY rec_id) AS last_end FROM chunks)
       SELECT rec_id, start, coalesce(lead(start) OVER (PARTITION BY rec_id ORDER BY chunk_no), last_end) AS "end", l::BIGINT AS label
       FROM c WHERE before IS NULL OR before <> l""",
    ("chunks",),
)
def _(t):
    return R.label_segments(t.chunks().withColumn("label", F.col("label") % 3), "rec_id")


ALIGNED = """aligned AS (SELECT s.rec_id, s.seg_no, s.start, s."end", trim(s.text) AS text, d.label::BIGINT AS label
        FROM segments s LEFT JOIN speaker_turns d ON s.rec_id = d.rec_id AND s.start < d."end" AND s."end" > d.start
          AND least(s."end", d."end") - greatest(s.start, d.start) > 0
        QUALIFY row_number() OVER (PARTITION BY s.rec_id, s.seg_no
          ORDER BY least(s."end", d."end") - greatest(s.start, d.start) DESC, d.start, d.label) = 1)"""


@query(
    "align_speakers",
    f"""WITH {ALIGNED} SELECT rec_id, seg_no, {q6('start')} AS start, {q6('"end"')} AS "end", text, label FROM aligned""",
    ("segments", "speaker_turns"),
)
def _(t):
    out = R.align_speakers(t.segments(), t.speaker_turns(), "rec_id")
    return out.select("rec_id", "seg_no", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"), "text", "label")


@query(
    "speaker_lines",
    f"""WITH {ALIGNED} SELECT rec_id, seg_no, CASE WHEN label IS NULL THEN 'Unknown Speaker: ' || text
          ELSE 'Speaker ' || (label + 1) || ': ' || text END AS line FROM aligned""",
    ("segments", "speaker_turns"),
)
def _(t):
    out = R.align_speakers(t.segments(), t.speaker_turns(), "rec_id")
    return out.select("rec_id", "seg_no", R.speaker_line(F.col("label"), F.col("text")).alias("line"))


STAGES = ["click", "view", "purchase", "signup", "error"]


@query(
    "stage_timings",
    "SELECT user_id, "
    + ", ".join(f"{q6(f'''sum(value) FILTER (WHERE event_type = '{s}')''')} AS {s}" for s in STAGES)
    + f", {q6('sum(value)')} AS total FROM events GROUP BY user_id",
)
def _(t):
    out = R.stage_timings(t.events, "user_id", "event_type", "value", STAGES)
    return out.select("user_id", *[r6(F.col(c)).alias(c) for c in [*STAGES, "total"]])
