"""Language identification by rank-order n-gram profiles.

Words are runs of letters, lower-cased and padded with a blank on both sides; n-grams have 1 to 3 characters. A
language's profile is its ``PROFILE`` most frequent n-grams over a sample of training documents (of ``FIT_ROWS`` in all every
language gets an equal share, or all it has; those of smallest 64-bit hash), a document's profile its own most frequent ones over its whole text; ties go to the smaller n-gram. The out-of-place distance adds up, over
the document's n-grams, the difference of the two ranks (``PROFILE`` where the language lacks the n-gram). The
nearest language wins, ties to the smaller name; ``score`` is 1 - distance / largest possible distance. Texts that
are null or without letters get ``und`` and score 0, and so does everything if nothing could be learned. Documents
without language, text or id teach nothing. Repeated rows are predicted one by one; an empty table gives an empty
result. Profiles are langs x ``PROFILE`` rows and go to every task; a language is a label, so their number is small.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.store import released, save
from pairloom.llm.words import BASE, BASE_INVERSE, mix, text_runs

PROFILE = 400
FIT_ROWS = 20_000
FLUSH = 1_000_000
RUN = 1 << 20
PAD = 32


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter; its lower case (itself where that is longer than one character)."""
    letters, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            letters[c] = True
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    return letters, lower


@cache
def code_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., as one array."""
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(int(lengths.sum()))


class Grams:
    """n-grams of a run of texts: ``names`` (sorted, packed code points); row r has words ``bounds[r]:bounds[r + 1]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        letters, lower = letter_tables()
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
        inside = letters[points]
        points = lower[points]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = at[:-1][np.diff(at) > 0]
        before[edges], after[edges - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = code_powers(1 << (len(points) + 1).bit_length())
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(points.astype(np.uint64)) * up[: len(points)], dtype=np.uint64)))
        names = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        self.word, distinct = pd.factorize(names)
        some = np.zeros(len(distinct), np.int64)
        some[self.word] = np.arange(len(names))
        self.bounds = np.searchsorted(start, at)
        # padded distinct words, one after the other
        lengths = (end - start)[some]
        wide = lengths + 2
        place = np.concatenate(([0], np.cumsum(wide)))[:-1]
        body = np.full(int(wide.sum()), PAD, np.int64)
        body[ragged(place + 1, lengths)] = points[ragged(start[some], lengths)]
        one = ragged(place + 1, lengths)
        two = ragged(place, lengths + 1)
        three = ragged(place, lengths)
        packed = np.concatenate((body[one] << 42, (body[two] << 42) | (body[two + 1] << 21), (body[three] << 42) | (body[three + 1] << 21) | body[three + 2]))
        owner = np.concatenate([np.repeat(np.arange(len(some)), k) for k in (lengths, lengths + 1, lengths)])
        found, distinct = pd.factorize(packed)
        order = np.argsort(distinct)
        self.names = distinct[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[found]
        order = np.argsort(owner, kind="stable")
        self.codes = codes[order]
        self.size = 3 * lengths + 1
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]

    def counts(self, word: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the words."""
        codes = self.codes[ragged(self.first[word], self.size[word])]
        return np.bincount(codes, minlength=len(self.names))

    def row_profile(self, r: int) -> np.ndarray:
        """Codes of the row's most frequent n-grams, best first."""
        counts = self.counts(self.word[self.bounds[r] : self.bounds[r + 1]])
        present = np.flatnonzero(counts)
        key = counts[present] * len(self.names) + (len(self.names) - 1 - present)
        if len(key) > PROFILE:
            top = np.argpartition(key, len(key) - PROFILE)[-PROFILE:]
            present, key = present[top], key[top]
        return present[np.argsort(-key)]


def learned_from(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Language to its packed n-grams, most frequent first, learned from a sample of about ``fit_rows`` documents.

    The sample holds the training documents whose hashed id falls below the share ``fit_rows`` / all of them.
    """

    def count(batches):
        totals: dict = defaultdict(int)

        def rows():
            langs, grams = zip(*totals) if totals else ((), ())
            columns = {"lang": pa.array(langs, pa.string()), "gram": pa.array(grams, pa.int64()), "n": pa.array(list(totals.values()), pa.int64())}
            totals.clear()
            return pa.record_batch(columns)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, raw, offsets in text_runs(batch.column(1), RUN):
                grams = Grams(raw, offsets)
                owner = np.repeat(langs[first : first + len(offsets) - 1], np.diff(grams.bounds))
                for name in set(owner):
                    own = owner == name
                    found = grams.counts(grams.word[own])
                    for k in np.flatnonzero(found):
                        totals[name, int(grams.names[k])] += int(found[k])
                if len(totals) > FLUSH:
                    yield rows()
        yield rows()

    train = docs.filter(learned_from(F.col(id_col)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(lang).count().collect()}  # one row per language
    each = max(1, fit_rows // max(1, len(sizes)))
    below = F.lit(-(1 << 63)).cast("bigint")  # a language with more rows than ``each`` gives those of smallest 64-bit hash
    for name, n in sizes.items():
        cut = (1 << 63) - 1 if n <= each else -(1 << 63) + (each << 64) // n
        below = F.when(F.col(lang) == name, F.lit(cut)).otherwise(below)
    train = train.filter(F.xxhash64(F.col(id_col).cast("string")) <= below)
    parts = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(released(count), "lang string, gram bigint, n bigint")
    totals = save(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "profiles")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in best:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(grams, np.int64) for name, grams in profiles.items()}


def distances(profiles: dict[str, np.ndarray], names: np.ndarray) -> np.ndarray:
    """Rank of every named n-gram in each language (PROFILE where absent)."""
    ranks = np.full((len(profiles), len(names)), PROFILE, np.int64)
    for i, grams in enumerate(profiles.values()):
        at = np.searchsorted(names, grams)
        hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == grams) if len(names) else np.zeros(len(grams), bool)
        ranks[i, at[hit]] = np.flatnonzero(hit)
    return ranks


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``."""
    clash = {"lang_pred", "score"} & set(docs.columns)
    source = docs.drop(*clash)
    names = list(profiles)
    at = source.columns.index(text)

    def work(batches):
        for batch in batches:
            pred, score = [], []
            for _, raw, offsets in text_runs(batch.column(at), RUN):
                grams = Grams(raw, offsets)
                ranks = distances(profiles, grams.names)
                for r in range(len(offsets) - 1):
                    own = grams.row_profile(r)
                    if not len(own) or not names:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    there = ranks[:, own]
                    place = np.arange(len(own))
                    away = np.where(there < PROFILE, np.abs(there - place), PROFILE).sum(axis=1)
                    k = int(away.argmin())
                    pred.append(names[k])
                    score.append(1.0 - float(away[k]) / (PROFILE * len(own)))
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(released(work), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred, score per document."""
    profiles = fit(docs, id_col, text, lang)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text).alias("__text"))
    return predict(rows, profiles, "__text").drop("__text")
