"""Vectorised word splitting and hashing of Arrow text columns (a small NumPy helper run inside Spark tasks).

A task hands in an Arrow string column; the helper walks it in chunks of rows of about `CHUNK_BYTES` bytes of
text, so that memory is bounded by the chunk or by the longest single text.  Words are maximal runs of bytes
that a 256-entry table doesn't mark as separators, hashed in mixed lanes.  Runs of words are hashed by polynomial
prefix sums of these hashes modulo 2**64 with a final mix, so that the hash of any run comes from two prefix values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane


@lru_cache(maxsize=None)
def table(kind: str) -> np.ndarray:
    """Separator bytes. space: 0x20 and 0x09-0x0D. alnum: every ASCII byte but letters and digits."""
    t = np.zeros(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = True
    else:
        t[:128] = [not chr(b).isalnum() for b in range(128)]
    return t


@lru_cache(maxsize=None)
def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, for the odd base of a seed."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        base = (_B + 2 * seed * 0x632BE59BD9B4E019) & _M
        inverse = pow(base, -1, 1 << 64)
        size = max(n, 1 << 16)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[seed] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32 bits that spreads every input bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Words:
    """The words of a run of rows: byte spans, 64-bit hashes, and per row the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool):
        self.data = _lower()[data] if lower else data
        self.offsets = offsets
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = ~table(kind)[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            before[1:] = ~word[:-1]
            after = np.empty(len(data), bool)
            after[-1] = True
            after[:-1] = ~word[1:]
            self.start = np.flatnonzero(word & (before | edge[:-1]))
            self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: words of row i: first[i] up to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.n = len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits of each word, in eight-byte lanes: each lane is mixed with a key of its place, and the sum with the length. Words of up to eight bytes and one length never collide; two seeds give independent bits."""
        n = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        keys = lambda i: mix64(np.asarray(i, np.uint64) * np.uint64(_B) + np.uint64(0xC2B2AE3D27D4EB4F * (2 * seed + 1) & _M))
        out = mix64((lanes[self.start] & _LANE[np.minimum(n, 8)]) ^ keys([0]))
        long = np.flatnonzero(n > 8)
        if len(long):
            k = (n[long] + 7) // 8
            row, i = np.repeat(long, k), counting(k)
            parts = mix64((lanes[self.start[row] + 8 * i] & _LANE[np.minimum(n[row] - 8 * i, 8)]) ^ keys(i))
            out[long] = np.add.reduceat(parts, np.cumsum(k) - k)
        return mix64(out + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def cells(self) -> np.ndarray:
        """Polynomial hashes modulo 2**64, for features only: structured words of some thousand bytes can share one."""
        p, inverse = powers(len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=c[1:])
        return mix64((c[self.end] - c[self.start]) * inverse[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, start: int, end: int, joiner: bytes = b" ") -> bytes:
        return joiner.join(self.data[s:e].tobytes() for s, e in zip(self.start[start:end], self.end[start:end], strict=True))


def runs(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of `width` consecutive entries (length n - width + 1, at least 0)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(hashes) + 1, seed)
    c = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * p[:-1], out=c[1:])
    return mix64((c[width:] - c[:-width]) * inverse[:n])


def span_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hashes of the entries lo[k] .. hi[k] - 1."""
    p, inverse = powers(len(hashes) + 1, seed)
    c = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * p[:-1], out=c[1:])
    return mix64((c[hi] - c[lo]) * inverse[lo])


def counting(n: np.ndarray) -> np.ndarray:
    """0 .. n[k] - 1 for each k, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """The positions at which a run of `width` words starts and ends within one row."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k in range(1, width):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return np.flatnonzero(ok)


def chunks(column: pa.Array, kind: str = "space", lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) over runs of rows with about `most` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return
    _, raw, text = column.buffers()
    offsets = np.frombuffer(raw, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        lo, hi = offsets[row], offsets[stop]
        yield row, stop, Words(data[lo:hi], offsets[row : stop + 1] - lo, kind, lower)
        row = stop


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
