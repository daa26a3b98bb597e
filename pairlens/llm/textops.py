"""Vectorised text helpers for Arrow batches: word bounds and hashes over the UTF-8 bytes of many texts.

All functions work on one batch at a time, so memory follows the batch and never the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Multiplier of the positional hash; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled together: the arrays below are about twenty times this.
BLOCK_BYTES = 1 << 18

#: Spans up to this length are hashed in arrays.
SHORT_BYTES = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space and all other ASCII characters that are neither letter nor digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
WHITE = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every [start, end); equal bytes have equal hashes anywhere.

    For features and seeds whose finds are verified: some different spans of 1024 bytes and more share a hash.
    """
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def strong_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every [start, end) without algebraic structure: the finaliser over steps of eight bytes, xxh3 for spans above SHORT_BYTES."""
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    steps = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(n.astype(np.uint64) * BASE)
    for done in range(0, SHORT_BYTES, 8):
        live = np.flatnonzero((n > done) & (n <= SHORT_BYTES))
        if not len(live):
            break
        part = steps[starts[live] + done] & _LOW_BYTES[np.minimum(n[live] - done, 8)]
        out[live] = mix((out[live] ^ part) + BASE)
    for k in np.flatnonzero(n > SHORT_BYTES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about BLOCK_BYTES: first row, end row, bytes, offsets. A longer text is a block of its own."""
    data, offsets = text_buffer(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of a block: byte bounds, hash, and the first word of every text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, hashes=None):
        data = _LOWER[data]
        inside = ~separators[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:]
        # a text's edge cuts a word that would run into the next text
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        edges = edges[inside[edges] & inside[edges - 1]]
        begin[edges] = True
        stop[edges] = True
        self.data = data
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop)
        self.hashes = (hashes or span_hashes)(data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)


def sequence_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several (already mixed) hashes in order."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = out * BASE + h
    return mix(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; the whole sequence if it is shorter, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    return sequence_hash([words[i : n - width + 1 + i] for i in range(width)])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
