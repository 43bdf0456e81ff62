"""Substring dedup with a compressed FM-index per shard.

Each shard indexes its word sequences: words become dense ids, the
Burrows-Wheeler transform of the sequences is kept as a wavelet matrix of
packed bits with block counts, and streamed runs are matched by backward
search, all of them in step.  The matching statistic at a position is the
number of words matched ending there; where it reaches ``length``, the rows
of the index that match form an interval, and the smallest document of the
interval (range minimum) decides.  Which shard holds which run follows from
the run's content-defined anchor (see ``repeats``), so each run meets all its
possible partners in one shard and no document is streamed past all shards.

Defined cases: a null or empty text has no words; a text of fewer than
``length`` words loses nothing; rows that repeat a doc_id are not smaller than
each other and keep their words; a null doc_id counts as the largest id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statline.llm import repeats as R
from statline.llm import sequences as S

LENGTH = 13
ANCHOR = 4
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Bits:
    """Packed bits with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) // 64 + 1) * 64
        padded = np.zeros(size, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(
            [[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, position: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = position >> 6
        low = (np.uint64(1) << (position & 63).view(np.uint64)) - np.uint64(1)
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & low)


class WaveletMatrix:
    """Counts of a symbol before a position, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.levels, self.zeros = len(symbols), [], []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one)))
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        # where each symbol's own positions begin below the last level
        every = np.arange(size)
        self.start = self._below(every, np.zeros_like(every))

    def _below(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            p = bits.ones(position)
            position = np.where(symbol >> bit & 1, zeros + p, position - p)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self._below(symbol, position) - self.start[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` or more symbols.

    As many ranks as fit into one word are compared at once.  Backward search
    for patterns of up to ``depth`` symbols asks only where the blocks of
    equal prefixes begin and end, so ties may stay in any order.
    """
    rank, n, reach = symbols.astype(np.int64), len(symbols), 1
    while True:
        bits = int(rank.max(initial=0) + 1).bit_length()
        parts = max(1, min(63 // bits, -(-depth // reach)))
        key = rank + 1
        for i in range(1, parts):
            key <<= bits
            key[: max(0, n - i * reach)] |= rank[i * reach:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        reach *= parts
        if reach >= depth or new[1:].all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)


class FMIndex:
    """Index of word sequences; each sequence belongs to a document."""

    def __init__(self, symbols: np.ndarray, size: int, doc: np.ndarray, depth: int):
        order = suffix_order(symbols, depth + 1)
        self.bwt = WaveletMatrix(symbols[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.smallest = [doc[order]]

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray):
        """Intervals of the patterns with one more symbol in front."""
        base = self.first[symbol]
        return base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document of each non-empty interval."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        while len(self.smallest) <= level.max(initial=0):
            last, half = self.smallest[-1], 1 << (len(self.smallest) - 1)
            self.smallest.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(lo), dtype=np.int64)
        for x in np.unique(level):
            at = level == x
            table = self.smallest[x]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << int(x))])
        return out


def earlier_documents(symbols: np.ndarray, size: int, doc: np.ndarray, ends: np.ndarray,
                      length: int) -> np.ndarray:
    """For windows of ``length`` words that end before ``ends``: the smallest
    document with such a window, by backward search."""
    index = FMIndex(symbols, size, doc, length)
    own = doc[ends - 1]
    least = own.copy()
    alive = np.arange(len(ends))
    last = symbols[ends - 1]
    lo, hi = index.first[last], index.first[last + 1]
    for matched in range(1, length + 1):
        if matched > 1:
            lo, hi = index.extend(lo, hi, symbols[ends[alive] - matched])
        more = hi - lo > 1  # a single match is the window itself
        alive, lo, hi = alive[more], lo[more], hi[more]
        if not len(alive):
            return least
    least[alive] = index.least(lo, hi)
    return least


def decider(length: int):
    def decide(pieces: pa.Array, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        buf, offsets = S.text_buffer(pieces)
        starts, ends, off = S.words(buf, offsets)
        hashes = S.word_hashes(buf, starts, ends)
        _, dense = np.unique(hashes, return_inverse=True)
        rows, count = len(n), np.diff(off)
        # a separator 0 after every piece; words are 1, 2, ...
        symbols = np.zeros(len(dense) + rows, dtype=np.int64)
        symbols[np.arange(len(dense)) + np.repeat(np.arange(rows), count)] = dense + 1
        doc = np.repeat(ids, count + 1)
        begin = off[:-1] + np.arange(rows)
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least = earlier_documents(symbols, int(symbols.max()) + 1, doc, at + length, length)
        return least < np.repeat(ids, n)
    return decide


def joined(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray,
           keep: np.ndarray) -> tuple[bytes, list[int]]:
    """The kept words of all rows, those of a row joined by one space, and
    where each row begins (and the last one ends)."""
    kept = np.flatnonzero(keep)
    count = np.concatenate([[0], np.cumsum(keep)])[words]
    first, stop = begin[kept], end[kept]
    # a word takes the byte behind it along, unless it is its row's last
    more = np.ones(len(kept), dtype=bool)
    more[count[1:][count[1:] > count[:-1]] - 1] = False
    step = np.zeros(len(buf) + 2, dtype=np.int8)
    step[first] += 1
    step[stop + more] -= 1
    out = buf.copy()
    out[stop[more]] = 0x20
    size = np.concatenate([[0], np.cumsum(stop + more - first)])
    return out[np.cumsum(step[:len(buf)], dtype=np.int8).view(bool)].tobytes(), size[count].tolist()


def _finish(length: int, texts: bool, rest: bool = False):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            row, start, stop = R.range_arrays(batch.column("ranges"))
            begin, end, words = S.words(buf, off)
            gone = R.cover(len(begin), words, row, start, stop, length)
            total = np.concatenate([[0], np.cumsum(gone)])
            raw, at = joined(buf, begin, end, words, ~gone)
            kept = [raw[a:b] for a, b in pairwise(at)]
            cols = [batch.column("doc_id"), pa.array(np.diff(words)),
                    pa.array(total[words[1:]] - total[words[:-1]])]
            if texts:
                cols.append(pa.array([t.decode("utf-8", "replace") for t in kept], pa.string()))
                names = ["doc_id", "n_words", "n_removed", "kept"]
            else:
                cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()))
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if rest:
                cols.append(batch.column("rest"))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return finish


def _marked(docs: DataFrame, length: int, columns: Sequence[str] = (),
            hot_kinds: int = R.HOT_KINDS) -> DataFrame:
    base = R.keyed(docs, columns)
    ranges = R.covered_ranges(base, length, min(ANCHOR, length), True, True, decider(length),
                              hot_kinds)
    return R.with_ranges(base, ranges)


def digests(docs: DataFrame, length: int = LENGTH, hot_kinds: int = R.HOT_KINDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _marked(docs, length, (), hot_kinds).mapInArrow(_finish(length, False), _RESULT)


def remaining(docs: DataFrame, length: int = LENGTH, columns: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words of every row,
    joined by one space), and the named other columns of the input."""
    return R.unpacked(_marked(docs, length, columns), _finish(length, True, bool(columns)),
                      "doc_id long, n_words long, n_removed long, kept string")
