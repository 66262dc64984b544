"""Repeated passages by sparse suffix arrays.

A passage is ``min_words`` (50) consecutive words, A-Z lower-cased. Steps:

1. Suffixes are kept only at content-selected positions: in every window of ``min_words`` words the leftmost smallest
   hash of ``KEY`` words is its minimiser. Equal windows have equal minimisers, wherever they stand.
2. The kept suffixes are sorted by the hash of their first words (a range-partitioned sort, which splits a key of any
   frequency over tasks) and compared with their neighbours; those that match none end here.
3. The others are extended to the left and right: every window that belongs to a matched minimiser is hashed as a
   whole and sorted and compared with its neighbours in the same way. A window that occurs twice is repeated; the
   one in the document with the smallest id, at the smallest position, is its first occurrence, the rest are later ones.
4. Overlapping repeated windows of a document join to spans; spans of later windows are what deduplication removes.

The result is exact up to 64-bit hashes: a word is in a span if and only if it lies in a repeated window. Equal texts are
one text in steps 1 to 3; all but the first document of an equal text (smallest id, null last) are later as a whole if
they have ``min_words`` words. Null and short texts have no spans. Repeated rows (equal id and text) get equal
spans; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import apart, likely_among, released, save, small_batches
from pairloom.llm.words import BASE, Words, mix, powers, text_runs

KEY = 18
SIGNED = np.int64


def minimisers(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, minimiser of each, key hashes): word indexes within the run."""
    keys = words.shingles(KEY)
    width = min_words - KEY + 1
    n = len(keys)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds)) - min_words
    starts = np.flatnonzero(np.arange(n) <= last)
    if not len(starts):
        return starts, starts, keys
    best, at, size = keys.copy(), np.arange(n), 1

    def merge(shift):
        m = n - shift
        right = best[shift:] < best[:m]
        best[:m] = np.where(right, best[shift:], best[:m])
        at[:m] = np.where(right, at[shift:], at[:m])

    while size * 2 <= width:
        merge(size)
        size *= 2
    if size < width:
        merge(width - size)
    return starts, at[starts], keys


def window_hashes(words: Words, starts: np.ndarray, size: int) -> np.ndarray:
    up, down = powers(len(words.hash) + 1)
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(words.hash * up[: len(words.hash)], out=total[1:], dtype=np.uint64)
    return mix((total[starts + size] - total[starts]) * down[starts] + BASE)


def seeds(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """(h, th, pos): the kept suffixes of every text; ``th`` names the text, ``pos`` the word."""

    def work(batches):
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for first, raw, offsets in text_runs(batch.column(1)):
                words = Words(raw, offsets)
                starts, at, keys = minimisers(words, min_words)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
                row = np.searchsorted(words.bounds, at, "right") - 1
                yield pa.record_batch(
                    {"h": pa.array(keys[at].view(SIGNED)), "th": pa.array(names[first + row]), "pos": pa.array((at - words.bounds[row]).astype(np.int32))}
                )

    return docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("t")).filter("t is not null").mapInArrow(released(work), "h bigint, th bigint, pos int")


def neighbours(rows: DataFrame, h: str, place: list[str], name: str) -> DataFrame:
    """Rows whose ``h`` occurs at two different places or more, with ``later``: not the first of these places.

    Rows are sorted by (h, place) over all partitions and compared with those beside them. Runs that touch a
    partition's border are settled among the border rows, two a partition.
    """
    columns = [h, *place]
    spread = save(rows.select(*columns), name)
    ordered = spread.repartitionByRange(*columns).sortWithinPartitions(*columns)

    def work(batches):
        held: list[pa.Table] = []  # the run at the end of what was read; at most one range partition
        first_run = True

        def settle(table: pa.Table, at_start: bool, at_end: bool):
            cols = [table.column(c).to_numpy() for c in columns]
            n = len(cols[0])
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cols = [c[new] for c in cols]
            n = len(cols[0])
            head = np.ones(n, bool)
            head[1:] = cols[0][1:] != cols[0][:-1]
            tail = np.append(head[1:], True)
            twin = ~(head & tail)
            border = np.zeros(n, bool)
            starts = np.flatnonzero(head)
            if at_start:
                border[0] = True
            if at_end:
                border[starts[-1]] = True
            keep = twin | border
            out = {c: pa.array(v[keep]) for c, v in zip(columns, cols)}
            return pa.record_batch({**out, "twin": pa.array(twin[keep]), "later": pa.array(~head[keep]), "border": pa.array(border[keep])})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            values = table.column(h).to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            if cut == 0 and held and held[0].column(h)[0].as_py() == values[0]:
                held.append(table)
                continue
            ready = pa.concat_tables([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
            if ready.num_rows:
                yield settle(ready, first_run, False)
                first_run = False
        if held:
            yield settle(pa.concat_tables(held), first_run, True)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema.fields)
    found = save(ordered.mapInArrow(released(work), f"{kinds}, twin boolean, later boolean, border boolean"), name + "-found")
    edge = found.filter("border")
    runs = edge.groupBy(h).agg(F.min(F.struct(*place)).alias("low"), F.max(F.struct(*place)).alias("high"), F.max("twin").alias("any"))
    runs = runs.filter("low <> high OR any")
    settled = edge.join(runs, h).select(*columns, (F.struct(*place) != F.col("low")).alias("later"))
    return found.filter("twin AND NOT border").select(*columns, "later").union(settled)


def spans_of(starts: Column, size: int) -> Column:
    """Sorted starts of windows to joined spans (a, b): b is one past the last word."""
    begin = F.filter(starts, lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + size))
    end = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (s + size < F.get(starts, i + 1)))
    return F.zip_with(begin, end, lambda a, b: F.struct(a.alias("a"), (b + size).alias("b")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(id, th, a, b, later): spans of repeated words, of first and of later occurrences."""
    small_batches(docs.sparkSession)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("bigint").alias("id"))
    named = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("th"), order.alias("o"))
    texts = named.groupBy("th").agg(F.min("o").alias("o"), F.count_distinct("o").alias("copies"))

    matched = neighbours(seeds(docs, text, min_words), "h", ["th", "pos"], "suffixes")
    wanted = matched.groupBy("th").agg(F.collect_set("pos").alias("at")).join(texts, "th")
    wanted = wanted.select("th", "at", F.col("o.none").alias("none"), F.col("o.id").alias("id"))
    wanted = wanted.repartitionByRange("none", "id", "th").sortWithinPartitions("none", "id", "th")
    wanted = save(wanted.select(F.monotonically_increasing_id().alias("node"), "*"), "matched")

    def extend(batches):
        for batch in batches:
            nodes, at = batch.column(0).to_numpy(), batch.column(1)
            for first, raw, offsets in text_runs(batch.column(2)):
                words = Words(raw, offsets)
                starts, best, _ = minimisers(words, min_words)
                chosen = [np.asarray(at[first + r].values, np.int64) + words.bounds[r] for r in range(len(offsets) - 1)]
                hit = np.zeros(len(words.hash) + 1, bool)
                hit[np.concatenate(chosen)] = True
                starts = starts[hit[best]]
                row = np.searchsorted(words.bounds, starts, "right") - 1
                hashes = window_hashes(words, starts, min_words)
                yield pa.record_batch(
                    {"w": pa.array(hashes.view(SIGNED)), "node": pa.array(nodes[first + row]), "s": pa.array((starts - words.bounds[row]).astype(np.int32))}
                )

    whole = docs.select(F.xxhash64(text).alias("th"), F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("t")).filter("t is not null")
    whole = whole.filter(likely_among(wanted, "th")("th"))
    joined = whole.alias("x").join(wanted.alias("y"), (F.col("x.th") == F.col("y.th")) & F.col("x.id").eqNullSafe(F.col("y.id")))
    windows = joined.select("node", "at", "t").mapInArrow(released(extend), "w bigint, node bigint, s int")
    repeated = neighbours(windows, "w", ["node", "s"], "windows")
    lines = repeated.groupBy("node", "later").agg(F.sort_array(F.collect_set("s")).alias("starts"))
    lines = lines.select("node", "later", F.inline(spans_of(F.col("starts"), min_words)))
    inside = lines.join(wanted.select("node", "th", "id"), "node").select("id", "th", "a", "b", "later")

    copied = texts.filter("copies > 1").select("th", "o")
    n = F.size(F.filter(F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    sized = docs.select(F.xxhash64(text).alias("th"), order.alias("own"), F.when(F.length(text) >= 2 * min_words - 1, n).alias("n"))
    copies = sized.join(copied, "th").filter(F.col("n") >= min_words)
    copies = copies.select(F.col("own.id").alias("id"), "th", F.lit(0).alias("a"), F.col("n").alias("b"), (F.col("own") != F.col("o")).alias("later"))
    return inside.union(copies.distinct())


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """One row per span: ``id_col``, first_word, end_word, n_words, later."""
    rows = repeated_spans(docs, id_col, text, min_words)
    out = rows.select(
        F.col("id").alias(id_col), F.col("a").cast("bigint").alias("first_word"), F.col("b").cast("bigint").alias("end_word"), (F.col("b") - F.col("a")).cast("bigint").alias("n_words"), "later"
    )
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """The documents without the words of their later spans; those left without a word go. All columns stay.

    What is cut leaves the white space before it; ``n_chars`` follows the text if present.
    """
    names, docs = docs.columns, apart(docs, "__id", "__th", "__cuts")
    later = repeated_spans(docs, id_col, text, min_words).filter("later")
    cuts = later.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("a", "b")).alias("__cuts"))
    same = (F.xxhash64(docs[text]) == cuts["__th"]) & docs[id_col].cast("bigint").eqNullSafe(cuts["__id"])
    joined = docs.join(cuts, same, "left").drop("__id", "__th")
    at = docs.columns.index(text)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches):
        for batch in batches:
            texts, sizes, keep = batch.column(at).to_pylist(), None, []
            cut = batch.column(len(docs_columns)).to_pylist()
            if counted is not None:
                sizes = batch.column(counted).to_pylist()
            for i, ranges in enumerate(cut):
                keep.append(True)
                if not ranges:
                    continue
                raw = np.frombuffer(texts[i].encode(), np.uint8)
                words = Words(raw, np.array([0, len(raw)]))
                gone = np.zeros(len(raw), bool)
                for r in ranges:
                    gone[words.start[r["a"]] : words.end[r["b"] - 1]] = True
                    if r["b"] < len(words.start):
                        gone[words.end[r["b"] - 1] : words.start[r["b"]]] = True
                texts[i] = raw[~gone].tobytes().decode()
                keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
                if sizes is not None:
                    sizes[i] = len(texts[i])
            columns = list(batch.columns[: len(docs_columns)])
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, docs_columns).filter(pa.array(keep, pa.bool_()))

    docs_columns = docs.columns
    return joined.mapInArrow(released(work), docs.schema).toDF(*names)
