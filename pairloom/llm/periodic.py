"""Runs of periodic words in whole texts, by recursive frequency splitting and a lag scan.

A run is a longest stretch of words with smallest period q that is at least ``max(least, times * q)`` words long. A
word of a run occurs at least ``times`` times in it, so a word that occurs less often within its segment can be in no
run of the segment: such words split it, and the pieces are counted again until nothing changes. The surviving
segments of many texts stand in one array, with a value of its own between two of them, and are scanned lag by lag.
A run with period q holds two whole blocks ``[k q, (k + 1) q)`` in a row that equal the blocks behind them, so only
the blocks of each lag are compared, by hash: all lags cost n log n. What is found is extended to both sides by
bisection over hashes and then compared word by word; a stretch known from a shorter period is passed over.

Words are runs of characters other than 09-0D and 20, compared exactly. A text is handled whole, in memory of one
task; a batch is cut into runs of about ``RUN`` characters. Null texts have no words. Repeated rows are handled each
for itself, rows without an id too; an empty table gives an empty result; other columns are not read, whatever their
names. Ties between runs do not arise: runs differ in start or period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import released
from pairloom.llm.words import mix, powers

RUN = 1 << 20  # characters of texts whose words are looked at together


def split(ids: np.ndarray, owner: np.ndarray, times: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Surviving segments as (place, length): ``ids`` are the words, ``owner`` the text of each word."""
    place = np.arange(len(ids))
    segment = owner.astype(np.int64)
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    words = int(ids.max()) + 1 if len(ids) else 1
    while len(place):
        _, which, counts = np.unique(segment * words + ids[place], return_inverse=True, return_counts=True)
        frequent = counts[which] >= times
        border = np.flatnonzero(np.diff(segment)) + 1
        starts = np.concatenate(([0], border))
        whole = np.logical_and.reduceat(frequent, starts)
        lengths = np.diff(np.append(starts, len(place)))
        stable.append((place[starts[whole]], lengths[whole]))
        keep = frequent & ~np.repeat(whole, lengths)
        place, segment = place[keep], segment[keep]
        if len(place):  # a new segment where words went in between; those too short for any run go
            fresh = np.concatenate(([True], (np.diff(place) > 1) | (np.diff(segment) > 0)))
            segment = np.cumsum(fresh) - 1
            keep = np.bincount(segment)[segment] >= least
            place, segment = place[keep], segment[keep]
    return [(p, n) for p, n in stable if len(p)]


class Found:
    """Runs by (start, end), and for each word the end and period of the longest one that covers it."""

    def __init__(self, n: int):
        self.runs: dict[tuple[int, int], int] = {}
        self.end, self.start, self.period = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        self.runs[start, end] = period
        shorter = start + np.flatnonzero(self.end[start:end] - self.start[start:end] < end - start)
        self.start[shorter], self.end[shorter], self.period[shorter] = start, end, period


class Scan:
    """Segments in one array; ``at`` leads back to the words."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, lengths: np.ndarray):
        size = lengths + 1  # and a value of its own after each
        last = np.cumsum(size) - 1
        inside = np.ones(int(size.sum()), bool)
        inside[last] = False
        self.at = np.zeros(len(inside), np.int64)
        self.at[inside] = np.repeat(at - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        self.at[last] = -1 - np.arange(len(last))
        self.values = np.where(inside, ids[self.at], self.at)
        up, self.down = powers(len(inside) + 1)
        self.total = np.zeros(len(inside) + 1, np.uint64)
        np.cumsum(mix(self.values.view(np.uint64)) * up[: len(inside)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def reach(self, place: np.ndarray, lag: int, step: int) -> np.ndarray:
        """How many words from ``place`` on (step 1) or before it (-1) equal those ``lag`` behind; below ``lag``."""
        low, n = np.zeros(len(place), np.int64), len(self.values)
        room = np.minimum(lag - 1, n - lag - place if step > 0 else place)
        high = np.maximum(room, 0)
        while (low < high).any():
            mid = (low + high + 1) // 2
            start = place if step > 0 else place - mid
            same = self.hash(start, start + mid) == self.hash(start + lag, start + lag + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def runs(self, lag: int, least: int, found: Found) -> Iterator[tuple[int, int]]:
        """(start, end) of the runs with period ``lag`` in the array, save those found with a shorter one."""
        edges = np.arange(0, len(self.values) + 1, lag)
        blocks = self.hash(edges[:-1], edges[1:])
        equal = np.concatenate(([False], blocks[1:] == blocks[:-1], [False]))
        if np.count_nonzero(equal) < 2:
            return
        turn = np.diff(equal.astype(np.int8))
        first, last = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
        long = last - first >= 2
        first, last = first[long] * lag, last[long] * lag
        word = self.at[first]
        fresh = (found.end[word] < word + last + lag - first) | (lag % found.period[word] > 0)
        first, last = first[fresh], last[fresh]
        start = first - self.reach(first, lag, -1)
        end = last + lag + self.reach(last, lag, 1)
        for a, b in zip(start.tolist(), end.tolist()):
            if b - a < least or (int(self.at[a]), int(self.at[a]) + b - a) in found.runs:
                continue
            low, high = max(a - 1, 0), min(b + 1, len(self.values))
            same = np.concatenate(([False], self.values[low : high - lag] == self.values[low + lag : high], [False]))
            turn = np.diff(same.astype(np.int8))  # one stretch, unless hashes of different words were equal
            for s, e in zip(np.flatnonzero(turn > 0).tolist(), np.flatnonzero(turn < 0).tolist()):
                if e - s + lag >= least:
                    yield int(self.at[low + s]), int(self.at[low + s]) + e - s + lag


def find_runs(ids: np.ndarray, owner: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; words of different owners share no run."""
    segments = split(ids, owner, times, least)
    if not segments:
        return []
    place, lengths = (np.concatenate(x) for x in zip(*segments))
    found = Found(len(ids))
    sizes = np.sort(lengths)
    behind = np.append(np.cumsum(sizes[::-1])[::-1], 0)  # words in segments of at least that size
    lag, scan, scanned = 1, None, 0
    while n := int(behind[np.searchsorted(sizes, need := max(least, times * lag))]):
        if scan is None or 2 * n < scanned:  # shorter segments hold no run of this period any more
            place, lengths = place[lengths >= need], lengths[lengths >= need]
            scan, scanned = Scan(ids, place, lengths), n
        for start, end in list(scan.runs(lag, need, found)):
            found.add(start, end, lag)
        lag += 1
    return sorted((start, end - start, period) for (start, end), period in found.runs.items())


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """``id_col``, n_words, runs by start and period, and collapsed: the words that are in no run after its first period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                words: list[bytes] = []
                bounds, size, first = [0], 0, at
                while at < len(batch) and (size < RUN or at == first):
                    value = batch.column(1)[at].as_py() or ""
                    words += value.encode().split()
                    bounds.append(len(words))
                    size += len(value)
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *outcome(words, bounds)], ["id", "n_words", "runs", "collapsed"])

    def outcome(words: list[bytes], bounds: list[int]) -> list[pa.Array]:
        listed = np.empty(len(words), object)
        listed[:] = words
        ids, _ = pd.factorize(listed)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        runs = find_runs(ids.astype(np.int64), owner, times, least)
        of = np.searchsorted(bounds, [r[0] for r in runs], "right") - 1
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        texts = []
        for a, b in zip(bounds, bounds[1:]):
            part = words[a:b]
            texts.append(b" ".join(part if (here := kept[a:b]).all() else [w for w, k in zip(part, here) if k]).decode())
        start, length, period = (np.array(x, np.int64) for x in (zip(*runs) if runs else ((), (), ())))
        rows = pa.StructArray.from_arrays([pa.array(start - np.array(bounds, np.int64)[of] if runs else start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        offsets = np.searchsorted(of, np.arange(len(bounds)))
        return [pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(texts, pa.string())]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(work), f"id {kind}, n_words bigint, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: number of runs, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    greater = lambda x, y: (  # noqa: E731  exact comparison of length / period, then smaller start, then smaller period
        F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
        .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1))
        .otherwise(0)
    )
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.get(F.array_sort("runs", greater), F.lit(0))
    rows = collapse(docs, id_col, text).withColumn("best", best)
    return rows.select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows; the words of every tenth text (by crc32 of its id) repeat from some word on with some period."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias(text))
