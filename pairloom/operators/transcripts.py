"""Timed segments: transcripts, windows and speaker alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.functions.arrays import unnest
from pairloom.functions import ordered


def transcript(
    segments: DataFrame, keys: list[str], order=("start", "seg_no"), slot_seconds: float = 3600.0, strip: bool = True
) -> DataFrame:
    """Texts of a recording joined by a space in order of time, blank ones skipped.

    Texts are first joined per stretch of ``slot_seconds``, then over the stretches. With
    ``strip=False`` texts are joined as they are.
    """
    rows = segments
    if strip:
        rows = rows.withColumn("text", X.strip(F.col("text"))).filter(F.length("text") > 0)
    return ordered.concat_ordered(
        rows, keys, F.floor(F.col(order[0]) / slot_seconds), list(order), "text", " ", "transcript"
    )


def explode_words(segments: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    return unnest(segments, keys, F.col(words), "w", "word_no").select(*keys, "word_no", "w.*")


def by_language(transcripts: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Transcripts of several passes side by side."""
    return transcripts.groupBy(key).pivot("lang", languages).agg(F.first("transcript"))


def window_chunks(
    recordings: DataFrame, key: str, duration: Column, rate: int, window_sec: float, overlap_sec: float, tail: bool = True
) -> DataFrame:
    """Overlapping windows over each recording, plus a right-aligned one where a tail is left.

    With ``tail=False`` only windows that end before the recording does; none where it is no longer than a window.
    """
    win, stride = int(window_sec * rate), int((window_sec - overlap_sec) * rate)
    rows = recordings.select(key, F.floor(duration * rate).cast("bigint").alias("total"))
    if not tail:
        starts = F.sequence(F.lit(0).cast("bigint"), F.col("total") - win - 1, F.lit(stride).cast("bigint"))
        cut = rows.filter(F.col("total") > win).select(key, F.posexplode(starts).alias("chunk_no", "s"))
        return cut.select(key, "chunk_no", (F.col("s") / rate).alias("start"), ((F.col("s") + win) / rate).alias("end"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.col("total") - win + 1) - 1, F.lit(stride).cast("bigint"))
    rows = rows.withColumn("starts", starts)
    left = F.element_at("starts", -1) + win < F.col("total")
    rows = rows.withColumn(
        "starts",
        F.when(left, F.concat("starts", F.array(F.greatest(F.lit(0), F.col("total") - win)))).otherwise(F.col("starts")),
    )
    cut = rows.select(key, "total", F.posexplode("starts").alias("chunk_no", "s"))
    return cut.select(
        key,
        "chunk_no",
        (F.col("s") / rate).alias("start"),
        (F.least(F.col("s") + win, F.col("total")) / rate).alias("end"),
    )


def frame_times(df: DataFrame, frame: str, step_sec: float, width_sec: float) -> DataFrame:
    start = F.col(frame) * F.lit(step_sec)
    return df.withColumn("start", start).withColumn("end", start + F.lit(width_sec))


def frame_times_even(df: DataFrame, frame: str, duration: Column, frames: Column) -> DataFrame:
    """Frames that share a recording's duration evenly: each takes duration / frames."""
    width = duration / frames
    return df.withColumn("start", F.col(frame) * width).withColumn("end", F.col(frame) * width + width)


def smoothing_kernel(kernel_sec: float, chunk_sec: float) -> int:
    """Odd number of chunks nearest to ``kernel_sec``; 1 means no smoothing."""
    if kernel_sec <= 0:
        return 1
    kernel = int(round(kernel_sec / chunk_sec))
    return max(kernel + 1 if kernel % 2 == 0 else kernel, 1)


def median_smooth(chunks: DataFrame, key: str, kernel: int, block_rows: int = 4096) -> DataFrame:
    """Median of the labels around each chunk, edges padded with zeros.

    ``chunk_no`` counts from 0 without gaps. Blocks of chunks are smoothed on their own;
    the chunks near a border are sent to both sides of it.
    """
    if kernel <= 1:
        return chunks
    half = kernel // 2
    n = F.col("chunk_no")
    slot = lambda at: F.floor(at / block_rows)
    near = F.array_distinct(F.array(slot(n - half), slot(n), slot(n + half)))
    spread = chunks.withColumn("__slot", F.explode(near))
    around = Window.partitionBy(key, "__slot").orderBy("chunk_no").rowsBetween(-half, half)
    labels = F.collect_list("label").over(around)
    padded = F.array_sort(F.concat(labels, F.array_repeat(F.lit(0), F.lit(kernel) - F.size(labels))))
    smoothed = spread.withColumn("__median", F.element_at(padded, half + 1)).filter(F.col("__slot") == slot(n))
    return smoothed.withColumn("label", F.col("__median").cast(chunks.schema["label"].dataType)).drop("__slot", "__median")


def label_segments(chunks: DataFrame, key: str, block_rows: int = 4096) -> DataFrame:
    """Runs of equal labels: a run ends where the next one starts, the last with its last chunk.

    ``chunk_no`` counts from 0 without gaps. The last chunk of a block is also sent to the next
    block, whose first chunk needs to know whether the label changed.
    """
    n = F.col("chunk_no")
    slot = lambda at: F.floor(at / block_rows)
    rows = chunks.select(key, "chunk_no", "start", "end", "label")
    spread = rows.withColumn("__slot", F.explode(F.array_distinct(F.array(slot(n), slot(n + 1)))))
    before = F.lag("label").over(Window.partitionBy(key, "__slot").orderBy("chunk_no"))
    starts = (
        spread.withColumn("__before", before)
        .filter((F.col("__slot") == slot(n)) & (F.col("__before").isNull() | (F.col("__before") != F.col("label"))))
        .select(key, "chunk_no", "start", "label")
    )
    runs = ordered.neighbours(starts, [key], slot(n), ["chunk_no"], "start", "__next", 1)
    ends = rows.groupBy(key).agg(F.max_by("end", "chunk_no").alias("__last"))
    return runs.join(ends, key).select(key, "start", F.coalesce("__next", "__last").alias("end"), "label")


ROOT_LEVEL = 48
LEAF_SHARE = 0.95


def _level(start: Column, end: Column) -> Column:
    """Level n whose nodes of 2^n seconds an interval spans two or three of at most; the root for endless ones."""
    steps = F.ceil(F.log2(F.greatest(end - start, F.lit(2.0**-10))))
    return F.when(start.isNotNull() & end.isNotNull(), F.least(steps, F.lit(ROOT_LEVEL))).cast("int")


def _in_tree(rows: DataFrame, start: str, end: str, levels: list[int], leaf: int) -> DataFrame:
    """Each interval at its own level, ``leaf`` at least, and at those above it of the given ``levels``."""
    own = F.greatest(F.col("__own"), F.lit(leaf))
    above = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > own)

    def nodes(level):
        width = F.pow(F.lit(2.0), level)
        whole = F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))
        root = F.array(F.lit(0).cast("bigint"))
        return F.transform(F.when(level == ROOT_LEVEL, root).otherwise(whole), lambda n: F.struct(level.alias("level"), n.alias("node")))

    at = F.flatten(F.transform(F.array_append(above, own), nodes))
    return rows.withColumn("__own", own).withColumn("__at", F.explode_outer(at))


def align_speakers(segments: DataFrame, turns: DataFrame, key: str, seg: str = "seg_no", leaf_share: float = LEAF_SHARE) -> DataFrame:
    """Label each segment with the turn it overlaps most; equal overlaps go to the earlier turn.

    Intervals meet in a dyadic tree of time: an interval stands at the level whose nodes are about its length, and once
    more at each higher level that the other side uses at all. Two overlapping intervals share a node at the level of the
    longer one. The leaves are as long as ``leaf_share`` of all intervals at most; a first pass counts intervals per
    level (at most ``ROOT_LEVEL`` + 11 a side). So a turn of 10^9 seconds is three rows, and a recording with most of
    the rows is dealt out over its nodes. The best turn is kept by a mergeable aggregate. Segments without overlap, or
    without a time, keep a NULL label; ``seg`` must be unique in its recording.
    """
    left = segments.select(key, seg, "start", "end", "text", _level(F.col("start"), F.col("end")).alias("__own"))
    right = turns.select(
        F.col(key).alias("__key"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("label").alias("t_label"),
        _level(F.col("start"), F.col("end")).alias("__own"),
    ).filter("t_end > t_start")
    sides = left.select(F.lit("l").alias("side"), "__own").unionAll(right.select(F.lit("r"), "__own"))
    counts = sides.filter("__own IS NOT NULL").groupBy("side", "__own").agg(F.count(F.lit(1)).alias("n")).collect()
    leaf, reached, total = 0, 0, sum(r["n"] for r in counts)
    for r in sorted(counts, key=lambda r: r["__own"]):
        if reached < leaf_share * total:
            leaf, reached = r["__own"], reached + r["n"]
    used = lambda side: sorted({max(r["__own"], leaf) for r in counts if r["side"] == side})
    left = _in_tree(left, "start", "end", used("r"), leaf).withColumnRenamed("__own", "__l_own")
    right = _in_tree(right, "t_start", "t_end", used("l"), leaf).withColumnsRenamed({"__own": "__r_own", "__at": "__t_at"})
    meet = (
        (F.col(key) == F.col("__key"))
        & (F.col("__at")["level"] == F.col("__t_at")["level"])
        & (F.col("__at")["node"] == F.col("__t_at")["node"])
        & (F.col("__at")["level"] == F.greatest("__l_own", "__r_own"))
        & (F.col("start") < F.col("t_end"))
        & (F.col("end") > F.col("t_start"))
    )
    overlap = F.least("end", "t_end") - F.greatest("start", "t_start")
    pairs = left.drop("text").join(right, meet).filter(overlap > 0)
    first = F.struct((-overlap).alias("o"), F.col("t_start").alias("s"), F.col("t_label").alias("l"))
    best = pairs.groupBy(key, seg).agg(F.min(first).alias("best"))
    rows = segments.select(key, seg, "start", "end", X.strip(F.col("text")).alias("text")).join(best, [key, seg], "left")
    return rows.select(key, seg, "start", "end", "text", F.col("best")["l"].alias("label"))


def speaker_line(label: Column, text: Column) -> Column:
    return F.when(label.isNull(), F.concat(F.lit("Unknown Speaker: "), text)).otherwise(
        F.concat(F.lit("Speaker "), (label + 1).cast("string"), F.lit(": "), text)
    )


def stage_timings(log: DataFrame, run: str, stage: str, seconds: str, stages: list[str]) -> DataFrame:
    """Seconds per stage and in total, one row per run."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    return log.groupBy(run).pivot(stage, stages).agg(F.sum(seconds)).withColumn("total", total)
