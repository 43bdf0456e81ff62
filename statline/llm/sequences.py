"""Vectorised helpers over the text buffer of an Arrow batch: word spans,
substring hashes, and content-defined anchors of fixed-length windows.

All functions work on whole numpy arrays (one array per batch, not per row);
documents are ranges of those arrays and windows never cross them.

Anchors.  For windows of ``w + k - 1`` symbols, the anchor of a window is the
position of its smallest k-gram hash (the leftmost on ties).  The choice
depends on the window's symbols alone, so equal windows have anchors at the
same offset, and a window whose anchor k-gram occurs once in the corpus is
itself unique.  Consecutive windows share an anchor; such a run is one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_INDEX_BITS = 24
# Symbols handled at once: an index must fit beside the hash in one word.
CHUNK = 1 << 20


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first n powers of a base; the longest array asked for is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n + n // 8, 1024), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * CHUNK:  # a single huge text leaves nothing behind
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads polynomial sums over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Hasher:
    """Hashes of any range of a symbol sequence in O(1) each."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(symbols, powers(n, BASE), out=self.prefix[1:])
        np.cumsum(self.prefix, out=self.prefix)
        self.inverse = powers(n + 1, INVERSE)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from every position on."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: n - k + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling widths."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = np.minimum(values[: len(values) - (width - have)], values[width - have:])
    return values


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its row offsets
    (n + 1 of them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if column.type != big:
        column = column.view(big) if pa.types.is_large_string(column.type) else column.cast(big)
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of whole rows of about ``size`` symbols each (a longer row alone)."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spans_of(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes inside each row: starts, ends, and the
    offsets of each row's runs."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = is_word[inner]
    stop[inner - 1] = is_word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    return spans_of(~_SPACE[buf], offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = Hasher(BYTE_VALUES[buf]).ranges(starts, ends)
    return mix(h + (ends - starts).astype(np.uint64))


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf).astype(np.uint8)


def window_mask(n: int, offsets: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a window of ``length`` symbols inside its row."""
    ok = np.zeros(max(0, n - length + 1), dtype=bool)
    if len(ok) == 0:
        return ok
    step = np.zeros(n + 2, dtype=np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(step, offsets[long], 1)
    np.add.at(step, offsets[long + 1] - length + 1, -1)
    return np.cumsum(step)[: len(ok)] > 0


def anchor_runs(hasher: Hasher, offsets: np.ndarray, length: int, k: int):
    """Runs of windows of ``length`` symbols with one anchor k-gram.

    Returns row, first window start, last window start, anchor position
    (all positions in the sequence) and the anchor's k-gram hash.
    """
    n = len(hasher.prefix) - 1
    none = np.zeros(0, np.int64)
    valid = window_mask(n, offsets, length)
    if not valid.any():
        return none, none, none, none, none.astype(np.uint64)
    if n >= 1 << 30:
        raise ValueError("a sequence of 2**30 symbols or more in one batch")
    bits = max(_INDEX_BITS, n.bit_length())
    grams = hasher.grams(k)
    mask = np.uint64((1 << bits) - 1)
    key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, length - k + 1) & mask).astype(np.int64)
    change = np.ones(len(at), dtype=bool)
    change[1:] = at[1:] != at[:-1]
    change[1:] |= valid[1:] != valid[:-1]
    starts = offsets[(offsets > 0) & (offsets < len(at))]
    change[starts] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(at)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, last, at[first], grams[at[first]]
