"""Vectorised text kernels over UTF-8 buffers: words, segment hashes, rolling hashes.

All kernels work on plain numpy arrays, so that an Arrow batch of texts is
processed without a Python object for every word. A chunk holds whole texts; a
text longer than the chunk size makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10
#: Short texts: kernels that keep a row of features for each text stay small.
CHUNK_TEXTS = 512

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, self.base, np.uint64)
            down = np.full(size, _inverse(self.base), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) applied to every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class TextChunk:
    """Some whole texts in one buffer: rows [first, first + n) of their batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[TextChunk]:
    """Splits a string column (null: empty) into chunks of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n, at + CHUNK_TEXTS) if most < 1 << 60 else n
        yield TextChunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def words(chunk: TextChunk, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than 0x20 and 0x09-0x0D (or those marked in
    ``between``), and the offsets of each text's words in them."""
    data, offsets = chunk.data, chunk.offsets
    space = between[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[starts[i]:ends[i]], equal for equal bytes."""
    n = len(data)
    up, down = _byte_powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each position at which n words follow,
    without regard to text boundaries."""
    total = len(word_hashes)
    if total < n:
        return np.zeros(0, np.uint64)
    up, down = _word_powers.upto(total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(word_hashes * up[:total], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: total - n + 1] + np.uint64(n))


def ragged_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def strings(values: list[bytes | str]) -> pa.Array:
    return pa.array([v.decode("utf-8") if isinstance(v, bytes) else v for v in values], pa.string())
