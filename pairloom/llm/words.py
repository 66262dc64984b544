"""Words, word hashes and shingle hashes of a batch of texts, in whole-array operations.

Texts arrive as an Arrow column. A batch is cut into runs of rows of about ``RUN_BYTES`` (a longer
text is a run by itself), so memory follows the longest text and not the batch. Words are runs of
bytes other than 09-0D and 20 after A-Z are lower-cased; that rule sees only ASCII bytes and is
therefore safe on UTF-8. A word's hash is a polynomial of its bytes modulo 2^64, taken from one
running sum over the run, then mixed. Equal 64-bit hashes are taken as equal words or shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets within them) for runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """Words of a run: byte ``start`` and ``end``, 64-bit ``hash``; row r has words ``bounds[r]:bounds[r + 1]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        body = LOWER[raw]
        inside = ~SPACE[body]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False
        after[edges - 1] = False  # the byte before a row's first one; for the first row this is the last byte
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        up, down = powers(len(body) + 1)
        total = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(VALUES[body] * up[: len(body)], out=total[1:], dtype=np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that run beyond their row must not be used."""
        out = np.full(len(self.hash), n, np.uint64)
        for j in range(min(n, len(out))):
            out[: len(out) - j] = (out[: len(out) - j] ^ self.hash[j:]) * BASE + np.uint64(j)
            out ^= out >> np.uint64(29)
        return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence of words, as a one-element array."""
    out = np.uint64(1 + len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * BASE
            out ^= out >> np.uint64(29)
    return mix(np.array([out], np.uint64))
