"""Best-scoring segmentation into the pieces of a SentencePiece vocabulary, and back, in parallel over chunks.

Text is taken as it is: a blank is put in front, blanks become U+2581, and a character without a piece is spelled in byte pieces (so is
U+2581 itself, which keeps decoding exact). A piece of rank r scores -round(1000 ln(r + 2)), a byte piece ``BYTE_SCORE``; scores are
whole numbers, so sums do not depend on their order. The best sum wins; among equal ones, from the end, the longest last piece.

Documents are cut into chunks of ``CHUNK`` characters. A boundary's state is the distance from it to the first piece that starts at
or after it (below ``REACH``, the longest piece). A chunk yields the matrix of best scores from state to state (max-plus transfer
matrix); products of these matrices are associative, and the running product gives each chunk the scores of its entry states. From
these a chunk finds, by itself, the best pieces for every exit state and the entry state they came from; chaining
these small maps from the end picks one exit per chunk. Only a document of several chunks needs the first two
steps; its chunks are spread over tasks. No piece has a blank after another character, so before each run of blanks every path has a
boundary: words are segmented once and remembered, and a chunk with such a place needs its states only at both ends.

One row per chunk: start (of the chunk's first piece, in characters), n_tokens, ids, decoded_crc32. Null and empty texts have one
chunk without tokens. Repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import released, save, small_batches

CHUNK = 32_768
CACHE = 300_000
SHORT = 64
TOGETHER = 8_192
GROUP_CHARS = 1 << 20
TEXTS = 32
BLANK = "▁"
SEGMENT = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")
BYTE_SCORE = -20_000
NONE = -(1 << 60)


class Pieces(dict):
    """The vocabulary; as a mapping, a segment's ids (little-endian 32-bit), remembered until there are ``CACHE`` of them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, spelled = {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                spelled.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = -round(1000 * math.log(i + 2))
                spelled.append(piece.replace(BLANK, " ").encode())
        self.bytes0 = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
        self.reach = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("a piece holds a line break, or a blank after another character")
        self._build_trie()
        self.piece_score = np.full(len(spelled), BYTE_SCORE, np.int64)
        self.piece_score[list(self.ids.values())] = list(self.scores.values())
        self.length = np.array([len(s) for s in spelled])
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def prepare(self, text: str) -> tuple[str, str | None]:
        """Internal form, and the character that stands for U+2581 in it."""
        stand_in = None
        if BLANK in text:
            stand_in = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in text)
            text = text.replace(BLANK, stand_in)
        return text.replace(" ", BLANK), stand_in

    def spell(self, character: str, stand_in: str | None) -> list[int]:
        if character in self.ids:
            return [self.ids[character]]
        raw = (BLANK if character == stand_in else character).encode("utf-8", "surrogatepass")
        return [self.bytes0 + b for b in raw]

    def step(self, text: str, start: int, end: int, stand_in: str | None) -> int:
        """Score of the piece text[start:end], or NONE."""
        score = self.scores.get(text[start:end])
        if score is not None:
            return score
        if end - start > 1:
            return NONE
        return BYTE_SCORE * len(self.spell(text[start:end], stand_in))

    def best_path(self, text: str, entry: list[int], limit: int, stand_in: str | None = None):
        """Forward pass over pieces that start before ``limit``: values and, per position, where its last piece starts."""
        n = len(text)
        value = [*entry[: n + 1], *[NONE] * (n + 1 - len(entry))]
        back = [-1] * (n + 1)
        get, reach = self.scores.get, self.reach
        for e in range(1, n + 1):
            top, at = value[e], -1
            for s in range(max(0, e - reach), min(e, limit)):
                if value[s] == NONE:
                    continue
                score = get(text[s:e])
                if score is None:
                    if e - s > 1:
                        continue
                    score = self.step(text, s, e, stand_in)
                if value[s] + score > top:
                    top, at = value[s] + score, s
            value[e], back[e] = top, at
        return value, back

    def trace(self, text: str, back: list[int], end: int, stand_in: str | None) -> tuple[list[int], int]:
        """Ids of the path to ``end`` and the position where it entered."""
        out: list[list[int]] = []
        while back[end] >= 0:
            s = back[end]
            piece = text[s:end]
            out.append([self.ids[piece]] if piece in self.ids else self.spell(piece, stand_in))
            end = s
        return [i for part in reversed(out) for i in part], end

    def segment(self, segment: str, stand_in: str | None = None) -> tuple[list[int], int]:
        value, back = self.best_path(segment, [0], len(segment), stand_in)
        return self.trace(segment, back, len(segment), stand_in)[0], value[-1]

    def _build_trie(self):
        """Steps of the vocabulary's trie as sorted keys (node, character) with the node behind them."""
        characters = sorted({c for p in self.ids for c in p})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.alphabet = len(characters) + 1
        steps: dict[tuple[int, str], int] = {}
        named = {}
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, c), len(steps) + 1)
            named[node] = i
        keys = np.array([n * self.alphabet + int(self.code[ord(c)]) for n, c in steps], np.int64)
        order = np.argsort(keys)
        self.steps, self.targets = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.node_id = np.full(len(steps) + 1, -1, np.int64)
        self.node_id[list(named)] = list(named.values())
        self.id_score = np.zeros(max(self.ids.values()) + 1, np.int64)
        self.id_score[list(self.ids.values())] = [self.scores[p] for p in self.ids]

    def learn(self, segments: list[str]) -> None:
        """Segment many distinct segments at once and remember them: the forward pass runs over all of them, position by position."""
        segments = sorted(segments, key=len, reverse=True)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(x) for x in segments])
        first = np.cumsum(size) - size
        code = self.code[points]
        word = np.repeat(np.arange(len(size)), size)
        stop = (first + size)[word]
        reach = min(self.reach, int(size[0]))
        score = np.full((reach + 1, len(points)), NONE, np.int64)
        names = np.full((reach + 1, len(points)), -1, np.int64)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for n in range(1, reach + 1):
            key = node * self.alphabet + code[at + n - 1]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = (self.steps[place] == key) & (code[at + n - 1] > 0)
            at, node = at[hit], self.targets[place[hit]]
            ids = self.node_id[node]
            full = ids >= 0
            names[n, at[full]] = ids[full]
            score[n, at[full]] = self.id_score[ids[full]]
            more = at + n < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        spelled = names[1] < 0  # byte pieces
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        score[1, spelled] = BYTE_SCORE * width[spelled]
        names[1, spelled] = np.where(points[spelled] <= 0x7F, self.bytes0 + points[spelled], -2)
        row = first + np.arange(len(size))  # one value more than characters for each segment
        value = np.full(len(points) + len(size), NONE, np.int64)
        value[row] = 0
        length = np.zeros(len(value), np.int64)
        live = len(size)
        for e in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -e, "right"))
            best, took = np.full(live, NONE, np.int64), np.zeros(live, np.int64)
            for n in range(min(e, reach), 0, -1):  # longest first: it stays on ties
                now = value[row[:live] + e - n] + score[n, first[:live] + e - n]
                better = now > best
                best[better], took[better] = now[better], n
            value[row[:live] + e], length[row[:live] + e] = best, took
        where, end, found = np.arange(len(size)), size.copy(), []
        while len(where):
            n = length[row[where] + end[where]]
            end[where] -= n
            found.append((where, names[n, first[where] + end[where]]))
            where = where[end[where] > 0]
        words, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(words[::-1], kind="stable")  # the last piece came first
        words, ids = words[::-1][order], ids[::-1][order]
        raw, bounds = ids.astype("<u4").tobytes(), np.searchsorted(words, np.arange(len(size) + 1))
        odd = set(words[ids < 0].tolist())
        for i, x in enumerate(segments):
            self[x] = raw[4 * bounds[i] : 4 * bounds[i + 1]] if i not in odd else np.array(self.segment(x)[0], "<u4").tobytes()

    def remember(self, *texts: list[str]) -> None:
        """Have the ids of all segments of these texts at hand; new ones are segmented together, ``TOGETHER`` at a time."""
        if len(self) > CACHE:
            self.clear()
        new = [p for p in set().union(*texts) if p not in self]  # a difference from keys() would go through all of them
        short = [p for p in new if len(p) <= SHORT]
        for i in range(0, len(short), TOGETHER):
            self.learn(short[i : i + TOGETHER])
        for p in new:
            if len(p) > SHORT:
                self[p] = np.array(self.segment(p)[0], "<u4").tobytes()

    def cuts(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and the last place before ``size`` where every path has a boundary."""
        end = min(len(text), size)
        first = CUT.search(text, 0, end)
        if first is None:
            return None
        last = text.rfind(BLANK, 0, end)
        while text[last - 1] == BLANK:
            last -= 1
        return first.start(), last

    def joined_ids(self, text: str, stand_in: str | None) -> np.ndarray:
        """Ids of a text between two cuts, segment by segment."""
        parts = SEGMENT.findall(text)
        if stand_in is not None:
            return np.array([i for p in parts for i in self.segment(p, stand_in)[0]], "<u4")
        self.remember(parts)
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), "<u4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, segment by segment."""
        out = []
        group: list[list[str] | bytes] = []
        held = 0

        def finish():
            nonlocal held
            self.remember(*[parts for parts in group if isinstance(parts, list)])
            for parts in group:
                out.append(parts if isinstance(parts, bytes) else b"".join(map(self.__getitem__, parts)))
            group.clear()
            held = 0

        for text in texts:
            body, stand_in = self.prepare(text)
            parts = SEGMENT.findall(BLANK + body) if text else []
            group.append(parts if stand_in is None else b"".join(np.array(self.segment(p, stand_in)[0], "<u4").tobytes() for p in parts))
            held += len(text)
            if held > GROUP_CHARS:
                finish()
        finish()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, with the blank in front."""
        length = self.length[ids]
        shift = np.repeat(self.first[ids] - (np.cumsum(length) - length), length)
        return self.flat[shift + np.arange(int(length.sum()))].tobytes()

    def transfer(self, text: str, size: int, stand_in: str | None) -> np.ndarray:
        """Matrix of best scores from entry to exit states of a chunk; ``text`` goes on beyond ``size`` as far as a piece may."""
        r = self.reach
        cuts = self.cuts(text, size)
        out = np.full((r, r), NONE, np.int64)
        if not cuts:
            for o in range(min(r, len(text) + 1)):
                value, _ = self.best_path(text, [NONE] * o + [0], size, stand_in)
                tail = value[size : size + r]
                out[o, : len(tail)] = tail
            return out
        first, last = cuts
        inner = int(self.piece_score[self.joined_ids(text[first:last], stand_in)].sum())
        tail = np.full(r, NONE, np.int64)
        value = self.best_path(text[last:], [0], size - last, stand_in)[0][size - last : size - last + r]
        tail[: len(value)] = value
        for o in range(min(r, first + 1)):
            head = self.best_path(text[:first], [NONE] * o + [0], first, stand_in)[0][first]
            if head > NONE:
                out[o] = np.where(tail > NONE, head + inner + tail, NONE)
        return out

    def exits(self, text: str, size: int, entry: list[int], stand_in: str | None) -> list[tuple[int, list[int]] | None]:
        """For each exit state the entry state of its best path and the path's ids."""
        cuts = self.cuts(text, size)
        head: list[int] = []
        came = None
        if cuts:
            first, last = cuts
            value, back = self.best_path(text[:first], entry, first, stand_in)
            head, came = self.trace(text[:first], back, first, stand_in)
            head += self.joined_ids(text[first:last], stand_in).tolist()
            text, size, entry = text[last:], size - last, [0]
        value, back = self.best_path(text, entry, size, stand_in)
        out: list[tuple[int, list[int]] | None] = []
        for o in range(self.reach):
            if size + o > len(text) or value[size + o] == NONE:
                out.append(None)
                continue
            ids, start = self.trace(text, back, size + o, stand_in)
            out.append((came if came is not None else start, head + ids))
        return out


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: best scores through both, associative."""
    total = np.where((a[:, :, None] > NONE) & (b[None] > NONE), a[:, :, None] + b[None], NONE)
    return total.max(axis=1)


def _ids_column(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


ROWS = "id bigint, chunk int, start bigint, n_tokens bigint, ids array<int>, decoded_crc32 bigint"


def _row_batch(pieces: Pieces, keys, chunks, starts, parts) -> pa.RecordBatch:
    crc = []
    for chunk, part in zip(chunks, parts):
        crc.append(zlib.crc32(pieces.decode(np.frombuffer(part, np.int32))[1 if chunk == 0 else 0 :]))
    columns = [
        pa.array(keys, pa.int64()), pa.array(chunks, pa.int32()), pa.array(starts, pa.int64()),
        pa.array([len(p) // 4 for p in parts], pa.int64()), _ids_column(parts), pa.array(crc, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "chunk", "start", "n_tokens", "ids", "decoded_crc32"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``id_col``, chunk, start, n_tokens, ids, decoded_crc32: one row per chunk of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    one, many = rows.filter(F.length("t") < chunk), rows.filter(F.length("t") >= chunk)

    def whole(batches):
        pieces = loaded(model)
        for batch in batches:
            parts = pieces.encode_all(batch.column(1).to_pylist())
            yield _row_batch(pieces, batch.column(0).to_pylist(), [0] * len(parts), [0] * len(parts), parts)

    single = one.mapInArrow(released(whole), ROWS)

    # Documents of several chunks: chunk rows with the few characters behind them, spread over tasks.
    reach = 64
    number = F.sequence(F.lit(0), F.floor(F.length("t") / chunk).cast("int"))
    cut = many.select("id", F.xxhash64("t").alias("th"), F.length("t").alias("n"), "t", F.explode(number).alias("chunk"))
    # the blank in front is the first character of chunk 0, so every later chunk starts one character earlier in the text
    begin = F.when(F.col("chunk") == 0, 1).otherwise(F.col("chunk") * chunk)
    cut = cut.withColumn("last", F.col("chunk") == F.floor(F.col("n") / chunk))
    width = F.when(F.col("chunk") == 0, chunk - 1).otherwise(chunk)
    stand_in = F.col("t").contains(BLANK)
    cut = cut.select("id", "th", "chunk", "last", stand_in.alias("odd"), F.substring("t", begin, width + reach).alias("t"))
    cut = save(cut.repartition("id", "th", "chunk"), "chunks")

    def inner(pieces, t, number, last, odd):
        if pieces.reach > reach:
            raise ValueError("pieces are longer than the characters kept behind a chunk")
        body, stand = pieces.prepare(t)
        body = (BLANK if number == 0 else "") + body
        size = len(body) if last else chunk
        return body[: size + (0 if last else pieces.reach - 1)], size, stand

    def bodies(pieces, batch):
        for at in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(at, TEXTS).to_pylist()
            found = [inner(pieces, r["t"], r["chunk"], r["last"], r["odd"]) for r in rows]
            cuts = [(body, pieces.cuts(body, size)) for body, size, stand in found if stand is None]
            pieces.remember(*[SEGMENT.findall(body[c[0] : c[1]]) for body, c in cuts if c])
            yield from zip(rows, found)

    def matrices(batches):
        pieces = loaded(model)
        for batch in batches:
            out = []
            for _, (body, size, stand) in bodies(pieces, batch):
                out.append(pieces.transfer(body, size, stand).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["id", "th", "chunk", "last", "m"])

    moved = cut.mapInArrow(released(matrices), "id bigint, th bigint, chunk int, last boolean, m binary")

    def scan(key, group):
        order = np.argsort(group["chunk"].to_numpy(), kind="stable")
        ids, matrices_ = group["chunk"].to_numpy()[order], [group["m"][int(i)].as_py() for i in order]
        size = math.isqrt(len(matrices_[0]) // 8)
        state = np.full((1, size), NONE, np.int64)
        state[0, 0] = 0
        out_chunk, out_state, done = [], [], -1
        for c, m in zip(ids, matrices_):
            if c == done:  # a repeated row
                continue
            done = c
            out_chunk.append(int(c))
            out_state.append(state[0].tolist())
            state = combine(state, np.frombuffer(m, np.int64).reshape(size, size))
        n = len(out_chunk)
        return pa.table({"id": pa.array([key[0].as_py()] * n, pa.int64()), "th": pa.array([key[1].as_py()] * n, pa.int64()), "chunk": pa.array(out_chunk, pa.int32()), "entry": pa.array(out_state, pa.list_(pa.int64()))})

    entries = moved.groupBy("id", "th").applyInArrow(scan, "id bigint, th bigint, chunk int, entry array<bigint>")
    known = cut.alias("c").join(entries.alias("e"), F.col("c.id").eqNullSafe(F.col("e.id")) & (F.col("c.th") == F.col("e.th")) & (F.col("c.chunk") == F.col("e.chunk")))
    known = known.select("c.*", "e.entry")

    def paths(batches):
        pieces = loaded(model)
        for batch in batches:
            for r, (body, size, stand) in bodies(pieces, batch):
                found = pieces.exits(body, size, r["entry"], stand)
                states = [o for o, f in enumerate(found) if f is not None and (o == 0 or not r["last"])]
                n = len(states)
                columns = [
                    pa.array([r["id"]] * n, pa.int64()), pa.array([r["th"]] * n, pa.int64()), pa.array([r["chunk"]] * n, pa.int32()),
                    pa.array(states, pa.int32()), pa.array([found[o][0] for o in states], pa.int32()),
                    pa.array([found[o][1] for o in states], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "chunk", "exit", "entry", "ids"])

    routes = save(known.mapInArrow(released(paths), "id bigint, th bigint, chunk int, exit int, entry int, ids array<int>"), "routes")

    def choose(key, group):
        came = {(c, e): s for c, e, s in zip(*(group[x].to_pylist() for x in ("chunk", "exit", "entry")))}
        state, picked = 0, []
        for c in range(max(c for c, _ in came), -1, -1):
            picked.append((c, state, came[c, state]))
            state = came[c, state]
        columns = list(zip(*picked))
        n = len(picked)
        return pa.table({"id": pa.array([key[0].as_py()] * n, pa.int64()), "th": pa.array([key[1].as_py()] * n, pa.int64()), **{x: pa.array(v, pa.int32()) for x, v in zip(("chunk", "exit", "entry"), columns)}})

    chosen = routes.select("id", "th", "chunk", "exit", "entry").groupBy("id", "th").applyInArrow(choose, "id bigint, th bigint, chunk int, exit int, entry int")
    same = [F.col("r.id").eqNullSafe(F.col("k.id"))] + [F.col(f"r.{c}") == F.col(f"k.{c}") for c in ("th", "chunk", "exit")]
    condition = same[0] & same[1] & same[2] & same[3]
    final = routes.alias("r").join(chosen.alias("k"), condition).select("r.id", "r.chunk", "k.entry", "r.ids")

    def digest(batches):
        pieces = loaded(model)
        for batch in batches:
            numbers = batch.column(1).to_pylist()
            starts = [c * chunk + e - (1 if c or e else 0) for c, e in zip(numbers, batch.column(2).to_pylist())]
            parts = [np.asarray(x.values, np.int32).tobytes() for x in batch.column(3)]
            yield _row_batch(pieces, batch.column(0).to_pylist(), numbers, starts, parts)

    return single.union(final.mapInArrow(released(digest), ROWS)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """Text of every chunk row of :func:`encode`: ``id_col``, chunk, bytes (a chunk may end inside no character)."""

    def work(batches):
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(np.asarray(x.values, np.int64))[1 if c == 0 else 0 :] for x, c in zip(batch.column(2), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t.decode() for t in texts], pa.string())], [id_col, "chunk", "text"])

    return encoded.select(id_col, "chunk", "ids").mapInArrow(work, f"{id_col} bigint, chunk int, text string")
