"""Words, word hashes and n-gram hashes of an Arrow string column, in numpy.

A batch is cut into chunks of whole rows of about ``CHUNK_BYTES``; a longer
row is a chunk of its own. All arrays of a chunk are computed without a loop
over words. A word is a run of bytes outside 0x20 and 0x09-0x0D of the UTF-8
text, so it equals a match of ``[^\\x20\\x09-\\x0D]+``.

A hash of a byte range is a difference of prefix sums of ``table[byte] *
base**position`` modulo 2**64, moved to position 0 by the inverse power and
mixed; n-gram hashes are formed the same way over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Between words that consist of letters and digits: every other ASCII byte.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = [not chr(c).isalnum() for c in range(128)]

_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)
_TABLES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2)
           + np.uint64(1) for seed in (11, 29)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for many ranges; ``values`` are uint64."""
    pw, inv = powers(len(values) + 1, which)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[:-1], out=pre[1:])
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1] \
        if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64)


class Words:
    """The words of rows ``lo`` to ``hi`` of a batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int, lower: bool = False, space=SPACE):
        self.lo, self.hi = lo, hi
        self.base = int(off[lo])
        raw = data[self.base:int(off[hi])]
        self.data = LOWER[raw] if lower else raw
        self.bounds = off[lo:hi + 1] - self.base
        n = len(raw)
        gap = space[raw]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = gap[:-1], gap[1:]
            before[self.bounds[:-1][self.bounds[:-1] < n]] = True
            after[self.bounds[1:] - 1] = True
        ink = ~gap
        self.start = np.flatnonzero(ink & before)
        self.end = np.flatnonzero(ink & after) + 1
        self.first = np.searchsorted(self.start, self.bounds)  # of each row, and the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(hi - lo), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hash(_TABLES[which][self.data], self.start, self.end, which)

    def ngrams(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are all in its row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        return range_hash(hashes, at, at + k, which), self.row[:n] == self.row[k - 1:]


def chunks(col: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, space=SPACE) -> Iterator[Words]:
    """Words of a string column, a chunk of whole rows at a time; ``space``: the bytes between words."""
    data, off = string_buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Words(data, off, lo, hi, lower, space)
        lo = hi


def texts(col: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    data, off = string_buffers(col)
    view = memoryview(data)
    for i in range(len(off) - 1):
        yield bytes(view[off[i]:off[i + 1]])


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from its values and the length of each list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
