"""Array kernels over runs of whole texts: words, hashes, packed exchanges.

A ``Texts`` lays many UTF-8 texts end to end in one byte array, so that word
splitting and hashing cost a few NumPy passes instead of a Python step per word.
Hashes are of the content alone (position independent), equal for equal content.
A span is hashed eight bytes at a time, each step through a strong finaliser, and a
long one by BLAKE2b; a run of hashes is hashed as a tree of pairs.  No step is linear
in the content, so texts with structure (Thue-Morse words, say) are no likelier to
collide than others.  Two different contents collide in 64 bits with probability about
``n**2 / 2**65`` among ``n`` contents; where a removal follows from equality, 96 bits
are compared (``seed`` gives hashes that are independent of each other).
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


_LIBC = _libc()
if _LIBC is not None:
    # Arrays of 1 MB or more are mapped one by one (M_MMAP_THRESHOLD), so that a worker that waits for its next task holds none.
    _LIBC.mallopt(-3, 1 << 20)


def release() -> None:
    """Give memory that isn't used back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: Bytes that part words: space and the controls 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Working size of one array pass; a longer single text is still taken whole.
CHUNK_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_ODD = U64(0x9FB21C651E98DF25)
_SEEDS = [U64((k * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (1 << 64) - 1) for k in range(1, 9)]
#: Of eight bytes read as one number, those that the first k are.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Spans of up to so many bytes are hashed by array steps.
SHORT = 128


def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in order."""
    return mix((a * _ODD) ^ b)


def by_eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end come zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), U64, padded, strides=(1,))


class Texts:
    """Texts laid end to end: bytes ``buf``; text i is buf[off[i]:off[i+1]]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    @classmethod
    def from_arrow(cls, column) -> Texts:
        """From an Arrow string or binary column; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(buf[off[0] : off[-1]], off - off[0])

    def rows(self, lo: int, hi: int) -> Texts:
        return Texts(self.buf[self.off[lo] : self.off[hi]], self.off[lo : hi + 1] - self.off[lo])

    def chunks(self, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
        """Runs of texts (lo, hi) of at most ``most`` bytes, or of one text."""
        lo = 0
        while lo < len(self):
            hi = int(np.searchsorted(self.off, self.off[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), len(self))
            yield lo, hi
            lo = hi

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words before each text (n + 1 entries)."""
        word = ~IS_SPACE[self.buf]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.off] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.off).astype(np.int64)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of the byte spans; the length is part of the hash."""
        size = ends - starts
        out = mix(size.astype(U64) * _ODD + _SEEDS[seed])
        eights = by_eights(self.buf)
        at = np.flatnonzero((size > 0) & (size <= SHORT))
        h, place, left = out[at], starts[at], size[at]
        while len(at):
            h = then(h, eights[place] & FIRST[np.minimum(left, 8)])
            done = left <= 8
            out[at[done]] = h[done]
            on = ~done
            at, h, place, left = at[on], h[on], place[on] + 8, left[on] - 8
        key = bytes([seed])
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        return out

    def gram_hashes(self, length: int) -> np.ndarray:
        """Hashes of the ``length`` bytes from each place on, to the last that has so many, whatever text they are in."""
        n = len(self.buf) - length + 1
        if n < 1:
            return np.zeros(0, U64)
        eights = by_eights(self.buf)
        h = mix((eights[:n] & FIRST[min(length, 8)]) + _SEEDS[0])
        for k in range(8, length, 8):
            k = min(k, length - 8)
            h = then(h, eights[k : k + n])
        return h


def rolling(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive entries (n - length + 1 of them), as trees of pairs."""
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, U64)
    part, size, have = mix(h ^ _SEEDS[seed]), 1, 0
    out = np.full(n, length, U64) ^ _SEEDS[seed]
    while True:
        if length & size:
            out = then(out, part[have : have + n])
            have += size
        if have == length:
            return out
        part, size = then(part[:-size], part[size:]), 2 * size


def owner(off: np.ndarray) -> np.ndarray:
    """For entries parted by ``off``: the index of the text that each belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def by_runs(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and the starts of its runs of equal keys, or of equal (key, second)."""
    order = np.argsort(keys)
    if not len(keys):
        return order, order
    new = np.ones(len(keys), bool)
    dealt = keys[order]
    new[1:] = dealt[1:] != dealt[:-1]
    if second is not None:
        dealt = second[order]
        if (~new[1:] & (dealt[1:] != dealt[:-1])).any():
            # Different contents whose keys collide.
            order = np.lexsort((second, keys))
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, np.flatnonzero(new)


def extremes(keys: np.ndarray, values: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, or (key, second), sorted: the keys, a place of each, and the smallest and the largest of its values."""
    order, first = by_runs(keys, second)
    if not len(first):
        return keys, order, values, values
    dealt = values[order]
    return keys[order[first]], order[first], np.minimum.reduceat(dealt, first), np.maximum.reduceat(dealt, first)


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in ``sorted_values``, and whether they are there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == wanted


def find_pairs(keys: np.ndarray, second: np.ndarray, wanted: np.ndarray, wanted_second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted (key, second) among those, sorted by key, and whether they are there."""
    at, there = find(keys, wanted)
    left = np.flatnonzero(there)
    left = left[second[at[left]] != wanted_second[left]] if len(left) else left
    while len(left):
        at[left] += 1
        ended = (at[left] == len(keys)) | (keys[np.minimum(at[left], len(keys) - 1)] != wanted[left])
        there[left[ended]], at[left[ended]] = False, 0
        left = left[~ended]
        left = left[second[at[left]] != wanted_second[left]]
    return at, there


# Packed exchanges: many hashes travel as one binary value, sorted, as differences
# whose bytes are transposed, so that Spark's block compression removes the zero bytes.


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as bytes."""
    if not len(sorted_values):
        return b""
    step = np.diff(sorted_values.astype(U64, copy=False), prepend=U64(0))
    return step.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(U64).ravel(), dtype=U64)


def transposed(values: np.ndarray) -> bytes:
    """Any fixed-width values as bytes, byte planes apart."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def restored(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bucket_edges(n: int) -> np.ndarray:
    """Smallest hash of each of n buckets that cut the range of the upper 32 bits evenly."""
    return np.array([-(-(b << 32) // n) << 32 for b in range(n)], U64)


def by_bucket(sorted_hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Non-empty buckets and their slices of the sorted hashes."""
    cut = np.append(np.searchsorted(sorted_hashes, bucket_edges(n)), len(sorted_hashes))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), slice(int(cut[b]), int(cut[b + 1]))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of an ASCII string's CRC-32: bytes come in, each followed by eight shifts."""
    steps = f"flatten([[CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for s in string_split({text}, '')])"
    fold = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda a, b: {fold}), 4294967295)"
