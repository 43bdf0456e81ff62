"""Suffix-array dedup by prefix doubling: removes every byte covered by a
string of ``length`` bytes that also starts anywhere else.

Positions carry ranks: equal ranks at length L mean equal strings of L bytes.
Spark ranks sampled positions (anchors) at 64 bytes and drops the unique, then
reranks the rest by their whole neighbourhood; both are shuffles of small
(position, rank) rows (see ``repeats``).  Where neighbours differ, positions
are ranked exactly by sorting (rank, rank at a growing offset) pairs: 8 bytes,
16, 32, ... until a position is unique or past the threshold.

Defined cases: a null or empty text has no bytes and gives the digest of the
empty string; a text shorter than ``length`` loses nothing; repeated rows are
separate documents, so equal texts of ``length`` bytes or more lose all bytes;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statline.llm import repeats as R
from statline.llm import sequences as S

LENGTH = 200
ANCHOR = 64
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of every key, and how often each rank occurs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = number
    return rank, np.bincount(number)


def repeated_windows(buf: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of ``length`` bytes that starts twice or
    more; strings stay inside their piece.

    Prefix doubling: positions with a unique rank leave (their later ranks
    stay unique, so any number above all ranks does); the last step pairs
    the ranks at ``p`` and ``p + length - reach``, which overlap.
    """
    n = len(buf)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    reach = 1
    while reach * 2 <= min(length, 8):
        reach *= 2
    alive = np.flatnonzero(room >= reach)
    rank = np.full(n + length, -1, dtype=np.int64)
    key = np.zeros(len(alive), dtype=np.uint64)
    for i in range(reach):
        key = key << np.uint64(8) | buf[alive + i].astype(np.uint64)
    while True:
        got, count = ranks_of(key)
        rank[:] = -1
        twice = count[got] > 1
        alive, got = alive[twice], got[twice]
        rank[alive] = got
        if reach == length or not len(alive):
            break
        step = min(reach, length - reach)
        # both halves must have partners of their own, inside the piece
        keep = (room[alive] >= reach + step) & (rank[alive + step] >= 0)
        alive = alive[keep]
        key = rank[alive].astype(np.uint64) << np.uint64(32) | rank[alive + step].astype(np.uint64)
        reach += step
    found = np.zeros(n, dtype=bool)
    if reach == length:
        found[alive] = True
    return found


def decider(length: int):
    def decide(pieces: pa.Array, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        buf, offsets = S.text_buffer(pieces)
        found = repeated_windows(buf, offsets, length)
        starts = np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return found[starts]
    return decide


def _finish(length: int, texts: bool, rest: bool = False):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            row, start, stop = R.range_arrays(batch.column("ranges"))
            gone = R.cover(len(buf), off, row, start, stop, length)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = off[(off > 0) & (off < len(buf))]
            begins[inner] = gone[inner]
            total = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(begins)])
            removed = total[off[1:]] - total[off[:-1]]
            kept = [(buf[a:b][~gone[a:b]] if x else buf[a:b]).tobytes()
                    for a, b, x in zip(off[:-1], off[1:], removed, strict=True)]
            cols = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed),
                    pa.array(spans[off[1:]] - spans[off[:-1]])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
            if texts:
                cols.append(pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()))
                names.append("kept")
            else:
                cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()))
                names.append("kept_sha256")
            if rest:
                cols.append(batch.column("rest"))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return finish


def _marked(docs: DataFrame, length: int, columns: Sequence[str] = (),
            hot_kinds: int = R.HOT_KINDS) -> DataFrame:
    base = R.keyed(docs, columns)
    ranges = R.covered_ranges(base, length, min(ANCHOR, max(1, length // 3)), False, False,
                              decider(length), hot_kinds)
    return R.with_ranges(base, ranges)


def digests(docs: DataFrame, length: int = LENGTH, hot_kinds: int = R.HOT_KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _marked(docs, length, (), hot_kinds).mapInArrow(_finish(length, False), _RESULT)


def remaining(docs: DataFrame, length: int = LENGTH, columns: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining text of every
    row; a UTF-8 character that loses some of its bytes goes whole), and the
    named other columns of the input."""
    return R.unpacked(_marked(docs, length, columns), _finish(length, True, bool(columns)),
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept string")
