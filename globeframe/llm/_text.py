"""Vectorised text kernels: whole Arrow batches as byte buffers, never a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 2 << 20
SHORT = np.uint64(0x9FB21C651E98DF25)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a word of letters and digits: ASCII but for 0-9, A-Z, a-z.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class PrefixHash:
    """Prefix sums of a polynomial hash: ``of(s, e)`` hashes any byte range in O(1)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] :] if len(column) else data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text has a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(s, e - s)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Start, end and row of every maximal run of non-separator bytes; a run ends with its row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = separator[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(PrefixHash(data).of(start, end) + (end - start).astype(np.uint64))


def _factors(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def short_runs(hashes: np.ndarray, row: np.ndarray, n: int):
    """(hash, row) of every run of ``n`` words within a row, hashed as ``shingles`` hashes a row
    of just these words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, factor = np.zeros(m, np.uint64), _factors(n)
    for k in range(n):
        h += hashes[k : k + m] * factor[k]
    whole = row[:m] == row[n - 1 :]
    return mix(h[whole] + np.uint64(n) * SHORT), row[:m][whole]


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int):
    """(hash, row) of every run of ``width`` words within a row, in order; a row with fewer
    words, but one at least, has its whole sequence as its only shingle."""
    counts = np.bincount(row, minlength=n_rows)
    factor = _factors(width)
    m = len(hashes) - width + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for k in range(width):
            h += hashes[k : k + m] * factor[k]
        whole = row[:m] == row[width - 1 :]
        h, at = mix(h[whole]), row[:m][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += hashes[first[short[has]] + k] * factor[k]
        extra = mix(extra + counts[short].astype(np.uint64) * SHORT)
        order = np.argsort(np.concatenate([at, short]), kind="stable")
        h, at = np.concatenate([h, extra])[order], np.concatenate([at, short])[order]
    return h, at


def distinct_sets(h: np.ndarray, at: np.ndarray, n_rows: int):
    """Sorted distinct hashes of each row: (values, offsets)."""
    bounds = np.searchsorted(at, np.arange(n_rows + 1))
    values = h.copy()
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        values[s:e].sort()
    if not len(values):
        return values, np.zeros(n_rows + 1, np.int64)
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def shingle_sets(column, width: int, separator: np.ndarray = SPACE):
    """Sorted distinct shingle hashes of every text, ASCII letters lowered: (values, offsets)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, row = words(data, offsets, separator)
    h, at = shingles(word_hashes(data, start, end), row, len(offsets) - 1, width)
    return distinct_sets(h, at, len(offsets) - 1)
