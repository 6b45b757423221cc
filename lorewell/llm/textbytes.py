"""Vectorised word and line positions over the raw UTF-8 buffer of an Arrow string column.

The functions here work on whole Arrow batches: no text is decoded and no Python object is made per
word. Word classes that only name ASCII characters can be read off single bytes, because every byte
of a multi-byte UTF-8 character is 0x80 or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        out = np.empty(size, U64)
        out[0] = 1
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * U64(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """Maximal runs of bytes outside `sep`, never across two texts.

    start, end: byte positions in raw; bounds: for each text the place of its first word, and one more;
    hash: 64-bit hash of each word's bytes.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, fold: bool = False):
        self.raw, self.off = raw, off
        n = len(raw)
        word = ~sep[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, off)
        self._fold = fold
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            table = _TABLE[LOWER] if self._fold else _TABLE
            self._hash = spans_hash(self.raw, self.start, self.end, table)
        return self._hash

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """Hash of raw[start:end] for each span, by prefix sums of a polynomial modulo 2**64."""
    n = len(raw)
    pre = np.zeros(n + 1, U64)
    np.cumsum(table[raw] * powers(BASE, n), out=pre[1:])
    if not len(start):
        return np.zeros(0, U64)
    h = (pre[end] - pre[start]) * powers(BASE_INV, n + 1)[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling (Rabin-Karp) hash of words[i:i+k] for i in 0..len-k; the caller leaves out those that cross texts."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    pre = np.zeros(n + 1, U64)
    np.cumsum(words * powers(BASE, n), out=pre[1:])
    return mix((pre[k:] - pre[:-k]) * powers(BASE_INV, n)[: n - k + 1])


def inside(bounds: np.ndarray, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i with i..i+k-1 in one text, and each one's text."""
    lens = np.diff(bounds)
    text = np.repeat(np.arange(len(lens)), np.maximum(lens - k + 1, 0))
    if not len(text):
        return np.zeros(0, np.int64), text
    have = np.maximum(lens - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(have)[:-1]))
    return np.arange(len(text)) - np.repeat(begin, have) + np.repeat(bounds[:-1], have), text


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """The batch in parts of about `most` bytes of text at least one row each, so that temporaries stay bounded."""
    col = batch.column(batch.schema.get_field_index(text))
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.frombuffer(np.ascontiguousarray(np.asarray(_lengths(col))), np.int64)
    at, total = 0, 0
    for i in range(n):
        if total and total + sizes[i] > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += sizes[i]
    yield batch.slice(at, n - at)


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
