"""Token counts of whole texts under a byte-level pair vocabulary, by rank-synchronous array merging.

A text is cut at special strings, then into pre-tokens. The distinct pre-tokens of many texts form one ragged array of
byte symbols. In each round every sequence finds its lowest-ranked pair and merges all its places at once, left to
right; sequences without a pair leave, and what is left of them counts. A merge can only make pairs of higher rank
than its own (checked when the file is read), so this is the order of the one-by-one rule. Sequences are first cut
where two neighbouring bytes stand together in no token: no merge can cross such a place, so a text in one giant
pre-token is many short sequences.

Pre-tokens follow the published rule of such tokenizers: a contraction (``'s 't 're 've 'm 'll 'd``), or letters, or
numbers, or other visible characters, each with one blank before them, or white space without the last one before a
visible character. Here the rule is read off from neighbouring character kinds of a whole run of texts.

Texts over ``RUN`` characters are split between a visible character and white space, where pre-tokens always end.
Memory of a task follows ``RUN`` and ``KNOWN`` remembered counts. Null texts are empty: 0
bytes, 0 tokens. Repeated rows are counted each for itself, rows without an id too; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import released
from pairloom.llm.words import mix, powers

RUN = 1 << 20  # characters of texts whose pre-tokens are merged together
KNOWN = 500_000  # remembered counts, beyond which only those of the run in hand are kept
SPACE, LETTER, NUMBER, OTHER = range(4)
NO_PAIR = np.iinfo(np.int32).max

SEAM = regex.compile(r"\P{White_Space}(?=\p{White_Space})")


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point."""
    if not _kinds:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(i) for i in range(0x110000))
        for kind, name in ((SPACE, "White_Space"), (LETTER, "L"), (NUMBER, "N")):
            for stretch in regex.finditer(rf"\p{{{name}}}+", every):
                table[stretch.start() : stretch.end()] = kind
        _kinds.append(table)
    return _kinds[0]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merge table of a tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, split = rules["model"], rules.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        odd += [k for t in rules["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t[k]]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or rules.get("normalizer") or odd:
            raise ValueError(f"not a plain byte-level pair vocabulary: {path} {odd}")
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.first = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = vocabulary[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)  # by rank
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        made = {letter: -1 for letter in letters}
        for rank, (a, b) in enumerate(pairs):
            if a not in made or b not in made:
                raise ValueError("a merge comes before its parts: simultaneous merging would differ")
            made.setdefault(a + b, rank)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for token in vocabulary:
            code = [letters[c] for c in token if c in letters]
            self.beside[code[:-1], code[1:]] = True
        specials = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
        self.special_ids = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NO_PAIR)

    def cut_bytes(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the sequences that byte strings fall into, and the first sequence of each string."""
        owner_start = np.cumsum(sizes) - sizes
        cut = np.ones(len(raw), bool)
        cut[1:] = ~self.beside[raw[:-1], raw[1:]]
        cut[owner_start] = True
        starts = np.flatnonzero(cut)
        return np.diff(np.append(starts, len(raw))), np.searchsorted(starts, owner_start)

    def surviving(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each non-empty byte string after all merges; the strings stand one after the other in ``raw``."""
        lengths, first = self.cut_bytes(raw, sizes)
        return np.add.reduceat(self.merge(self.first[raw], lengths), first)

    def symbols(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols themselves, one string after the other, and their number per string."""
        lengths, first = self.cut_bytes(raw, sizes)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = self.merge(self.first[raw], lengths, done)
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for which, n, found in done:
            out[np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(len(found))] = found
        return out, np.add.reduceat(counts, first)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, done: list | None = None) -> np.ndarray:
        """Final length of each sequence of the ragged array; ``done`` gets (sequences, lengths, symbols) as they end."""
        out = np.ones(len(lengths), np.int64)
        live, single = np.flatnonzero(lengths > 1), lengths == 1
        if done is not None:
            done.append((np.flatnonzero(single), lengths[single], symbols[np.repeat(single, lengths)]))
        symbols, lengths = symbols[np.repeat(~single, lengths)], lengths[live]
        ends = np.cumsum(lengths)
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(live):
            lowest = np.minimum.reduceat(rank, ends - lengths)
            going = lowest < NO_PAIR
            if not going.all():
                out[live[~going]] = lengths[~going]
                keep = np.repeat(going, lengths)
                if done is not None:
                    done.append((live[~going], lengths[~going], symbols[~keep]))
                symbols, rank, live, lengths, lowest = symbols[keep], rank[keep], live[going], lengths[going], lowest[going]
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            if len(hit) > 1 and (chained := np.diff(hit) == 1).any():  # a pair of equal symbols: every other place of a stretch
                order = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), order, 0))
                hit = hit[(order - begin) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            of = np.searchsorted(np.cumsum(lengths), hit, "right")
            last = np.cumsum(lengths)[of] - 1 == hit + 1  # the merged symbol ends its sequence
            first = np.cumsum(lengths)[of] - lengths[of] == hit
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            lengths = lengths - np.bincount(of, minlength=len(lengths))
            ends = np.cumsum(lengths)
            place = hit - np.arange(len(hit))
            rank[place[last]] = NO_PAIR
            after = np.concatenate([place[~last], place[~first] - 1])
            rank[after] = self.ranks(symbols[after], symbols[after + 1])
        return out


_loaded: dict[str, Merges] = {}


def loaded(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def token_starts(codes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether each character begins a pre-token; ``edge`` marks first characters of texts and ends with three marks."""
    kind = kinds()[codes]
    change = edge[:-3].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    after_space = np.flatnonzero(change & ~edge[:-3] & (kind != SPACE))
    after_space = after_space[kind[after_space - 1] == SPACE]
    start[after_space - 1] = True  # the last one of a stretch of white space stands apart from the others
    start[after_space] = codes[after_space - 1] != 32  # and a blank goes with what follows
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[~edge[quote + 1]]
    following = np.concatenate([codes, np.zeros(3, codes.dtype)])
    second = np.where(edge[quote + 2], 0, following[quote + 2])
    size = np.isin(following[quote + 1], [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        size[(following[quote + 1] == ord(a)) & (second == ord(b))] = 2
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + size + 1
    rest = rest[~edge[rest]]
    start[rest] = True
    return start


class Pretokens:
    """The pre-tokens of some non-empty texts without special strings, distinct ones by 64-bit hash."""

    def __init__(self, texts: list[str]):
        self.codes = codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, texts)])
        edge = np.zeros(len(codes) + 3, bool)
        edge[begin[:-1]] = edge[-3:] = True
        starts = np.flatnonzero(token_starts(codes, edge))
        ends = np.append(starts[1:], len(codes))
        up, down = powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * up[: len(codes)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.hashes, example, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.first, self.lengths = starts[example], (ends - starts)[example]
        self.of_text = np.searchsorted(starts, begin[:-1])  # the first pre-token of each text

    def spelled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of some distinct pre-tokens, one after the other, and their sizes."""
        first, lengths = self.first[some], self.lengths[some]
        chosen = self.codes[np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        wide = 1 + (chosen >= 0x80) + (chosen >= 0x800) + (chosen >= 0x10000)
        raw = np.frombuffer(chosen.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return raw, np.add.reduceat(wide, np.cumsum(lengths) - lengths)


class Counts:
    """Token counts of texts. Counts of pre-tokens are remembered by 64-bit hash; equal hashes are taken as equal."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of_run(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of some non-empty texts without special strings."""
        seen = Pretokens(texts)
        found = np.zeros(len(seen.hashes), np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, seen.hashes), len(self.known) - 1)
            hit = self.known[at] == seen.hashes
            found[hit] = self.counts[at[hit]]
        new = np.flatnonzero(found == 0)
        if len(new):
            found[new] = self.merges.surviving(*seen.spelled(new))
            kept = len(self.known) < KNOWN
            fresh = new if kept else slice(None)
            keys = np.concatenate([self.known[: len(self.known) * kept], seen.hashes[fresh]])
            order = np.argsort(keys, kind="stable")
            self.counts = np.concatenate([self.counts[: len(self.counts) * kept], found[fresh]])[order]
            self.known = keys[order]
        return np.add.reduceat(found[seen.which], seen.of_text)

    def of(self, texts: Iterable[str | None]) -> list[int]:
        out, run, places, size = [], [], [], 0

        def flush():
            for place, n in zip(places, self.of_run(run).tolist() if run else []):
                out[place] += n

        for place, text in enumerate(texts):
            out.append(0)
            pieces = [text or ""]
            if self.merges.special and self.merges.special.search(pieces[0]):
                pieces = self.merges.special.split(pieces[0])
                out[place] += len(pieces) - 1
            for part in (part for piece in pieces for part in cut(piece)):
                run.append(part)
                places.append(place)
                size += len(part)
                if size >= RUN:
                    flush()
                    run, places, size = [], [], 0
        flush()
        return out


def cut(text: str) -> Iterator[str]:
    """A text in parts of about ``RUN`` characters that end where pre-tokens end anyway; nothing of an empty text."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + RUN) if len(text) - at > RUN else None
        end = seam.end() if seam else len(text)
        yield text[at:end]
        at = end


class Ids:
    """Token ids of texts, by the same merges; ids of pre-tokens are remembered like their counts."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known = np.zeros(0, np.uint64)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of_run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some non-empty texts without special strings."""
        seen = Pretokens(texts)
        start, size = np.zeros(len(seen.hashes), np.int64), np.zeros(len(seen.hashes), np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, seen.hashes), len(self.known) - 1)
            hit = self.known[at] == seen.hashes
            start[hit], size[hit] = self.start[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(size == 0)
        if len(new):
            if len(self.known) + len(new) > KNOWN:  # from here on only what this run holds
                old = np.flatnonzero(size)
                self.flat, self.known = self.gathered(start[old], size[old]), seen.hashes[old]
                self.size, self.start = size[old], np.cumsum(size[old]) - size[old]
                start[old] = self.start
            more, sizes = self.merges.symbols(*seen.spelled(new))
            start[new], size[new] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
            self.flat = np.concatenate([self.flat, more])
            keys = np.concatenate([self.known, seen.hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.known = keys[order]
            self.start, self.size = np.concatenate([self.start, start[new]])[order], np.concatenate([self.size, size[new]])[order]
        each = size[seen.which]
        ids = self.gathered(start[seen.which], each)
        return np.split(ids, np.add.reduceat(each, seen.of_text).cumsum()[:-1])

    def gathered(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text, in order; special strings inside texts are their own ids."""
        rows: list[list] = []
        run, places, size = [], [], 0

        def flush():
            for (row, place), ids in zip(places, self.of_run(run) if run else []):
                row[place] = ids
            run.clear()
            places.clear()

        for text in texts:
            row: list = []
            rows.append(row)
            pieces = self.merges.special.splititer(text) if text and self.merges.special else [text or ""]
            marks = iter(self.merges.special.findall(text)) if text and self.merges.special else iter(())
            for k, piece in enumerate(pieces):
                if k:
                    row.append(np.array([self.merges.special_ids[next(marks)]], np.int32))
                for part in cut(piece):
                    places.append((row, len(row)))
                    row.append(None)
                    run.append(part)
                    size += len(part)
                    if size >= RUN:
                        flush()
                        size = 0
                        for done in rows[:-1]:
                            yield np.concatenate(done) if done else self.flat[:0]
                        del rows[:-1]
        flush()
        for done in rows:
            yield np.concatenate(done) if done else self.flat[:0]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(loaded(tokenizer))
        for batch in batches:
            tokens = counts.of(value.as_py() for value in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(released(work), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
