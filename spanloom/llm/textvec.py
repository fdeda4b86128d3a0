"""Words and shingles of whole Arrow batches as numpy arrays, for use inside Spark tasks.

A word is a maximal run of bytes other than [\\x20\\x09-\\x0D]; UTF-8 never uses those bytes inside a
longer character, so bytes and code points give the same words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240501)
#: Odd multipliers for the words of a shingle or window, by place.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SEEDS = _rng.integers(1, 2**63, 2, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of a text that are looked at in one go, so that a very long text takes no more temporaries than others.
BLOCK = 1 << 20
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer text is a range of its own."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) uint64: 128 bits of each byte range, by BLAKE2b."""
    view = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.uint64).reshape(-1, 2)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """`lanes` (1 or 2) independent 64-bit hashes of each byte range. Ranges of up to SHORT bytes are mixed eight bytes at
    a time, each step being non-linear in all bytes before; longer ones are BLAKE2b digests."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    load = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = [np.empty(len(starts), dtype=np.uint64) for _ in range(lanes)]
    for lo in range(0, len(starts), 1 << 17):
        at = starts[lo : lo + (1 << 17)]
        size = ends[lo : lo + (1 << 17)] - at
        states = [mix(size.astype(np.uint64) ^ _SEEDS[i]) for i in range(lanes)]
        todo = np.arange(len(at))
        for step in range(SHORT // 8):
            todo = todo[size[todo] > 8 * step] if step else todo
            if not len(todo):
                break
            left = np.minimum(size[todo] - 8 * step, 8)
            word = load[at[todo] + 8 * step] & _MASK[left]
            for i, h in enumerate(states):
                h[todo] = mix((h[todo] ^ word) * PLACE[i] + _SEEDS[i])
        long = np.flatnonzero(size > SHORT)
        if len(long):
            found = digests(data, at[long], at[long] + size[long])
            for i, h in enumerate(states):
                h[long] = found[:, i]
        for i, h in enumerate(states):
            out[i][lo : lo + len(at)] = h
    return out


class Words:
    """starts, ends: byte ranges; first: index of each text's first word (and the total at the end); hashes: one a word;
    others: a second, independent hash a word if lanes is 2."""

    def __init__(self, column: pa.Array, lower: bool = False, lanes: int = 1):
        data, self.offsets = raw(column)
        if lower:
            data = _LOWER[data]
        self.data, n = data, len(data)
        starts, ends = [], []
        for lo in range(0, n, BLOCK):  # a block with one byte on either side
            hi = min(n, lo + BLOCK)
            solid = np.zeros(hi - lo + 2, dtype=bool)
            solid[1:-1] = ~_SPACE[data[lo:hi]]
            solid[0] = lo > 0 and not _SPACE[data[lo - 1]]
            solid[-1] = hi < n and not _SPACE[data[hi]]
            edge = np.zeros(hi - lo + 1, dtype=bool)
            edge[self.offsets[np.searchsorted(self.offsets, lo) : np.searchsorted(self.offsets, hi, "right")] - lo] = True
            starts.append(np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1])) + lo)
            ends.append(np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + lo + 1)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.first = np.searchsorted(self.starts, self.offsets)
        if lanes:
            self.hashes, *rest = hash_ranges(data, self.starts, self.ends, lanes)
            self.others = rest[0] if rest else None

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on (k - 1 fewer than there are words)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * PLACE[j]
    return mix(out)


def shingle_sets(words: Words, k: int, lanes: int = 1) -> list[np.ndarray] | list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct k-word shingles as sorted hashes; fewer words: the whole sequence as one; no word: none.
    With two lanes, pairs of arrays: the sorted hashes and the second hash of the same shingles."""
    hashes = [words.hashes, words.others][:lanes]
    all_grams, first, out = [grams(h, k) for h in hashes], words.first, []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k and lanes == 1:
            g = np.sort(all_grams[0][lo : hi - k + 1])
            keep = np.empty(len(g), dtype=bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif hi - lo >= k:
            g, at = np.unique(all_grams[0][lo : hi - k + 1], return_index=True)
            out.append((g, all_grams[1][lo : hi - k + 1][at]))
        elif hi > lo:
            own = [mix(np.array([(h[lo:hi] * PLACE[: hi - lo]).sum(dtype=np.uint64) + U(hi - lo)], dtype=np.uint64)) for h in hashes]
            out.append(own[0] if lanes == 1 else tuple(own))
        else:
            out.append(np.zeros(0, dtype=np.uint64) if lanes == 1 else (np.zeros(0, dtype=np.uint64),) * 2)
    return out
