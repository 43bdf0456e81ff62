"""Per-document counts, vectorised over a batch, and labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:")] = True


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(row: np.ndarray, key: np.ndarray):
    """For elements of rows, in order: equal to an earlier one, and equal to
    any other one of the same row."""
    key = S.mix(key + row.astype(np.uint64) * np.uint64(S.BASE))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same
    twin = same.copy()
    twin[:-1] |= same[1:]
    any_[order] = twin
    return later, any_


def counts(buf: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Counts of every row:

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words inside a
    window of ``window`` words that stands twice or more in the row), n_lines
    (lines with a word), n_upper, n_digits, n_marks (``!`` and ``?``),
    n_stops (``.,;:``), n_echoes (words equal to the word before them).
    """
    starts, ends, words = S.words(buf, offsets)
    n = np.diff(words)
    symbols = S.BYTE_VALUES[buf]
    hasher = S.Hasher(symbols)
    in_word = ~S._SPACE[buf]
    out = {
        "n_words": n,
        "word_chars": _sum(in_word & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": _sum(_SYMBOL[buf], offsets),
        "n_upper": _sum((buf >= 65) & (buf <= 90), offsets),
        "n_digits": _sum((buf >= 48) & (buf <= 57), offsets),
        "n_marks": _sum((buf == 33) | (buf == 63), offsets),
        "n_stops": _sum(_STOP[buf], offsets),
    }
    line_start, line_end, lines = S.spans_of(buf != 0x0A, offsets)
    filled = np.concatenate([[0], np.cumsum(in_word)])
    full = filled[line_end] > filled[line_start]
    row = np.repeat(np.arange(len(n)), np.diff(lines))
    key = S.mix(hasher.ranges(line_start, line_end) + (line_end - line_start).astype(np.uint64))
    later, _ = _repeats(row[full], key[full])
    out["n_lines"] = np.bincount(row[full], minlength=len(n))
    out["n_dup_lines"] = np.bincount(row[full][later], minlength=len(n))
    hashes = S.mix(hasher.ranges(starts, ends) + (ends - starts).astype(np.uint64))
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[words[:-1][n > 0]] = False
    out["n_echoes"] = _sum(echo, words)
    word_hasher = S.Hasher(hashes)
    at = np.flatnonzero(S.window_mask(len(starts), words, window))
    repeated = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(at):
        row = np.searchsorted(words, at, side="right") - 1
        _, twin = _repeats(row, word_hasher.ranges(at, at + window))
        np.add.at(repeated, at[twin], 1)
        np.add.at(repeated, at[twin] + window, -1)
    out["n_repeat_words"] = _sum(np.cumsum(repeated)[:-1] > 0, words)
    return out


def held_out():
    """The fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2,
                      F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id and label of up to ``rows`` labelled documents outside the held
    out fold, in the order of a hash of the id (so a larger bound keeps them)."""
    return (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.max(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
