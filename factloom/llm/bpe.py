"""Byte-pair merging with segment trees, and an encoder that works segment by segment.

Every segment (a pre-token) has a segment tree over its symbol positions. A leaf
holds ``rank * width + position`` of the pair that starts there, so that the root
is the leftmost pair of least rank. A merge rewrites one symbol and updates the
leaves of the merged position, its left live neighbour and the position that
died, each in a logarithmic number of steps. Short segments are merged many at a
time, one row of a matrix each; long ones one by one.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

from factloom.llm import text_kernels as tk

_NONE = np.int64(1) << np.int64(60)
_WIDEST = 64
_BLOCK = 8192


class PairTable:
    """Maps a pair of symbol ids (below 65,536) to (rank, merged id)."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 16) | np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], np.asarray(rank, np.int64)[order], np.asarray(merged, np.int32)[order]
        self.lookup: dict[int, tuple[int, int]] | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (_NONE: no such pair) and merged ids."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        keys = (left.astype(np.int64) << 16) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE), self.merged[at]

    def one(self, left: int, right: int) -> tuple[int, int] | None:
        if self.lookup is None:
            self.lookup = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self.lookup.get((left << 16) | right)


def merge_long(symbols: list[int], pairs: PairTable) -> list[int]:
    """Merges one segment with a scalar segment tree."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none = (1 << 60) * width
    tree, symbols = [none] * (2 * width), list(symbols)
    after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n

    def leaf(i: int) -> None:
        if after[i] < n and (found := pairs.one(symbols[i], symbols[after[i]])):
            tree[width + i], merged[i] = found[0] * width + i, found[1]
        else:
            tree[width + i] = none

    def lift(i: int) -> None:
        i = (width + i) >> 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    for i in range(n):
        leaf(i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    alive = [True] * n
    while tree[1] < none:
        i = tree[1] % width
        gone = after[i]
        symbols[i], after[i], alive[gone] = merged[i], after[gone], False
        if after[i] < n:
            before[after[i]] = i
        tree[width + gone] = none
        leaf(i)
        lift(gone)
        lift(i)
        if before[i] >= 0:
            leaf(before[i])
            lift(before[i])
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def _merge_block(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merges each row of a matrix (width a power of two); dead positions become -1.

    All matrices are kept flat: one tree of 2 * width nodes and one run of width
    positions for every row.
    """
    rows, width = symbols.shape
    symbols = np.ascontiguousarray(symbols).ravel()
    after = np.tile(np.arange(1, width + 1), rows)
    before = np.tile(np.arange(-1, width - 1), rows)
    tree = np.full((rows, 2 * width), _NONE)
    merged = np.zeros(rows * width, np.int32)
    r, i = np.nonzero(np.arange(1, width + 1)[None, :] < lengths[:, None])
    at = r * width + i
    rank, new = pairs.find(symbols[at], symbols[at + 1])
    tree[r, width + i] = np.where(rank < _NONE, rank * width + i, _NONE)
    merged[at] = new
    for level in range(width.bit_length() - 2, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
    tree = tree.ravel()
    live = np.arange(rows)
    while True:
        root = tree.take(live * (2 * width) + 1)
        more = root < _NONE
        if not more.any():
            return symbols.reshape(rows, width)
        live, i = live[more], root[more] & (width - 1)
        row, top = live * width, live * (2 * width)
        at = row + i
        gone = after.take(at)
        symbols[at] = merged.take(at)
        symbols[row + gone] = -1
        beyond = after.take(row + gone)
        after[at] = beyond
        tree[top + width + gone] = _NONE
        tree[top + width + i] = _NONE
        has = np.flatnonzero(beyond < lengths.take(live))
        here, there = at[has], (row + beyond)[has]
        before[there] = i[has]
        rank, new = pairs.find(symbols.take(here), symbols.take(there))
        tree[(top + width + i)[has]] = np.where(rank < _NONE, rank * width + i[has], _NONE)
        merged[here] = new
        back = before.take(at)
        has = np.flatnonzero(back >= 0)
        here, there = (row + back)[has], at[has]
        rank, new = pairs.find(symbols.take(here), symbols.take(there))
        tree[(top + width + back)[has]] = np.where(rank < _NONE, rank * width + back[has], _NONE)
        merged[here] = new
        places = [width + gone, width + i, width + np.maximum(back, 0)]
        for _ in range(width.bit_length() - 1):
            for k, p in enumerate(places):
                places[k] = p = p >> 1
                child = top + 2 * p
                tree[top + p] = np.minimum(tree.take(child), tree.take(child + 1))


def merge_segments(symbols: np.ndarray, offsets: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges segments given as ragged symbols; returns ragged ids and their offsets."""
    lengths = np.diff(offsets)
    n = len(lengths)
    counts = lengths.copy()
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(lengths == 1), symbols[offsets[:-1][lengths == 1]].astype(np.int32))]
    width = 2
    while width <= _WIDEST:
        which = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        for lo in range(0, len(which), _BLOCK):
            own = which[lo : lo + _BLOCK]
            at = np.arange(width)
            inside = at[None, :] < lengths[own][:, None]
            block = np.full((len(own), width), -1, np.int32)
            block[inside] = symbols[tk.ragged_index(offsets[own], lengths[own])]
            block = _merge_block(block, lengths[own], pairs)
            counts[own] = (block >= 0).sum(1)
            parts.append((own, block[block >= 0]))
        width *= 2
    for k in np.flatnonzero(lengths > _WIDEST):
        ids = merge_long(symbols[offsets[k] : offsets[k + 1]].tolist(), pairs)
        counts[k] = len(ids)
        parts.append((np.array([k]), np.array(ids, np.int32)))
    out_offsets = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=out_offsets[1:])
    out = np.zeros(int(out_offsets[-1]), np.int32)
    for own, ids in parts:
        if len(own):
            out[tk.ragged_index(out_offsets[own], counts[own])] = ids
    return out, out_offsets


def _equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[a_starts[i]:][:lengths[i]] and b[b_starts[i]:][:lengths[i]] are equal, for each i."""
    differ = np.flatnonzero(a[tk.ragged_index(a_starts, lengths)] != b[tk.ragged_index(b_starts, lengths)])
    out = np.ones(len(lengths), bool)
    if len(differ):
        out[np.searchsorted(np.cumsum(lengths), differ, "right")] = False
    return out


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.all):
            self.all = np.concatenate([self.all, np.zeros(max(need, 2 * len(self.all)) - len(self.all), self.all.dtype)])
        self.all[self.size : need] = values
        self.size = need


class SegmentEncoder:
    """Encodes segments through a bounded cache of segments and their ids.

    Segments are looked up by a hash and compared byte for byte with what the cache
    holds; those that differ from it are encoded by themselves. ``encode_new`` takes a list of
    segments (bytes) and returns ragged ids. The cache is dropped when it is full, which changes
    no result. Its hashes stand in sorted runs of falling size, which are merged as they grow.
    """

    def __init__(self, encode_new, most: int = 1_000_000, most_bytes: int = 32 << 20):
        self.encode_new, self.most, self.most_bytes = encode_new, most, most_bytes
        self._reset()

    def _reset(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.starts, self.counts, self.begins, self.lengths = (_Grown(np.int64) for _ in range(4))
        self.ids, self.raw = _Grown(np.int32), _Grown(np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's segment in the cache, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        for known, number in self.runs:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            out = np.where(known[at] == hashes, number[at], out)
        return out

    def _keep(self, hashes: np.ndarray, texts: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> None:
        number = self.starts.size + np.arange(len(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts.add(self.ids.size + offsets[:-1])
        self.counts.add(np.diff(offsets))
        self.begins.add(self.raw.size + np.cumsum(sizes) - sizes)
        self.lengths.add(sizes)
        self.ids.add(ids)
        self.raw.add(np.frombuffer(b"".join(texts), np.uint8))
        run = (hashes, number)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):
            known, own = self.runs.pop()
            both = np.concatenate([known, run[0]])
            order = np.argsort(both, kind="stable")
            run = (both[order], np.concatenate([own, run[1]])[order])
        self.runs.append(run)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged ids of all segments in order, and the number of ids of each."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.starts.size > self.most or self.raw.size > self.most_bytes:
            self._reset()
        hashes, first, inverse = np.unique(tk.segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        raw = data.tobytes()
        if len(new):
            texts = [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            found[new] = self.starts.size + np.arange(len(new))
            self._keep(hashes[new], texts, *self.encode_new(texts))
        which = found[inverse]
        lengths = ends - starts
        same = lengths == self.lengths.all[which]
        at = np.flatnonzero(same)
        same[at] = _equal(data, starts[at], self.raw.all, self.begins.all[which[at]], lengths[at])
        begin, counts, ids = self.starts.all[which], self.counts.all[which], self.ids.all
        odd = np.flatnonzero(~same)
        if len(odd):  # another segment has this hash
            own, offsets = self.encode_new([raw[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
            begin[odd], counts[odd] = self.ids.size + offsets[:-1], np.diff(offsets)
            ids = np.concatenate([ids[: self.ids.size], own])
        return ids[tk.ragged_index(begin, counts)], counts


# ------------------------------------------------------------------ pre-tokens

#: Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, points):
            own = run.group()
            out[[ord(c) for c in own]] = kind
    out[WHITE_SPACE] = _SPACE
    return out


def pre_tokens(chunk: tk.TextChunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of a chunk, and each text's offsets in them.

    The tokens are the matches of the pattern of byte-level vocabularies:
    contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers or of other
    characters, with one space before them; white space, of which the last
    character before other text stands alone unless it is that space.
    """
    n = len(chunk.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk) + 1, np.int64)
    point = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    first = np.searchsorted(place, chunk.offsets)
    kind = _classes()[point]
    opens = np.zeros(len(point) + 3, bool)
    opens[first] = True
    size = len(point)
    change = np.ones(size, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= opens[:size]
    blank = kind == _SPACE
    joins = np.zeros(size, bool)
    joins[1:] = point[:-1] == 0x20
    joins &= ~opens[:size]
    starts = change & (blank | ~joins)
    lasts = blank[:-1] & ~blank[1:] & ~opens[1:size]
    starts[:-1] |= lasts
    for i in np.flatnonzero(starts[:-1] & (point[:-1] == 0x27) & (kind[1:] == _LETTER) & ~opens[1:size]).tolist():
        a = point[i + 1]
        if a in (0x73, 0x74, 0x6D, 0x64):
            k = 2
        elif i + 2 < size and not opens[i + 2] and (int(a), int(point[i + 2])) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            k = 3
        else:
            continue
        starts[i + 1] = False
        if i + k < size:
            starts[i + k] = True
    at = np.flatnonzero(starts)
    begin = place[at]
    return begin, np.append(begin[1:], n), np.searchsorted(at, first)


# ---------------------------------------------------------------- byte-level ranks


class ByteLevelEncoder:
    """Byte-level BPE by a rank file: bytes of a token and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(left, right, merged, merged)
        self.segments = SegmentEncoder(self._encode_new)
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def _encode_new(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.array([self.ranks.get(t, -1) for t in texts], np.int32)
        known = whole >= 0
        lengths = np.where(known, 1, np.array([len(t) for t in texts], np.int64))
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        rest = np.frombuffer(b"".join(t for t, k in zip(texts, known.tolist(), strict=True) if not k), np.uint8)
        symbols = np.zeros(int(offsets[-1]), np.int32)
        symbols[offsets[:-1][known]] = whole[known]
        symbols[tk.ragged_index(offsets[:-1][~known], lengths[~known])] = self.of_byte[rest]
        return merge_segments(symbols, offsets, self.pairs)

    def encode_chunk(self, chunk: tk.TextChunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and the offsets of each text's ids."""
        starts, ends, per_text = pre_tokens(chunk)
        ids, counts = self.segments.encode(chunk.data, starts, ends)
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        return ids, total[per_text]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)
