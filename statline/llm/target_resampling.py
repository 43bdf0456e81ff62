"""Importance resampling towards a target corpus, by bit-sliced aggregation.

Features are runs of one to two consecutive words (A-Z lower-cased; words of
ASCII letters, digits and all bytes beyond ASCII), joined by one space.  The
CRC-32 of a feature's bytes, modulo ``BUCKETS``, is its bucket.  The gain of a
bucket is the floor of 1000 times the log-ratio of its smoothed shares in the
target and in the documents, so it is an integer.

The weight of a document needs the sum of its features' gains.  Its bucket
counts are cut into bit planes: bit b of plane p is bit p of the count of
bucket b, 10,000 bits a plane.  The gains are cut the same way, once for their
positive and once for their negative values.  Then

    sum = sum over p, q of 2**(p+q) * (popcount(count[p] & plus[q])
                                       - popcount(count[p] & minus[q]))

is exact in integers.  A document takes as many planes as its largest count
has bits, whatever its length.

The draw adds Gumbel noise, from a hash of the id, to the weights and takes
the largest (a weighted sample without replacement).  Ranks come from a range
partitioning by (score, doc_id, row), so equal keys are split, and from the
number of rows in each partition; nothing is sorted in one task.

Defined cases: null and empty texts have no features, weight 0 and no rank; a
null doc_id counts as an empty one in the hash and comes last among ties;
rows that repeat a doc_id are drawn apart, in an arbitrary but fixed order if
all else is equal; ties go to the smaller doc_id; an empty table gives no
rows, an empty target smoothed shares alone; other columns are ignored by
``ranked`` and returned as they are by ``drawn``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import stored

BUCKETS = 10_000
WORDS = -(-BUCKETS // 64)
MIN_WORDS = 20
# Longer words are hashed one by one.
_SHORT = 48
# Documents whose planes are held at once.
_ROWS = 512

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The remainder of each byte by the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


@lru_cache(maxsize=1)
def crc_shifts() -> np.ndarray:
    """[n, i, b]: register byte b at place i, after n more zero bytes."""
    table = crc_table()
    have = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [have]
    for _ in range(_SHORT + 1):
        have = table[have & np.uint32(255)] ^ (have >> np.uint32(8))
        out.append(have)
    return np.stack(out)


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    shifts = crc_shifts()
    out = shifts[n, 0, crc & np.uint32(255)]
    for i in range(1, 4):
        out ^= shifts[n, i, crc >> np.uint32(8 * i) & np.uint32(255)]
    return out


def word_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, byte after byte for all words at once."""
    size = end - start
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    at, left = start[order], size[order]
    table, crc = crc_table(), np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    long = int((left > _SHORT).sum())
    lengths = left[long:]
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = long + int(np.searchsorted(-lengths, -i, side="left"))
        part = crc[long:n]
        crc[long:n] = table[(part ^ buf[at[long:n] + i]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    raw = buf.data
    for i in range(long):
        crc[i] = zlib.crc32(raw[at[i]:at[i] + left[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(buf: np.ndarray, offsets: np.ndarray):
    """Words and features of every row, and the row and bucket of each feature."""
    low = np.ascontiguousarray(S.ascii_lower(buf))
    start, end, rows = S.spans_of(_WORD[low], offsets)
    crc, size = word_crcs(low, start, end), end - start
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(row[1:] == row[:-1])
    second = first + 1
    # crc(a + " " + b) from crc(a + " ") and crc(b)
    a = crc[first] ^ np.uint32(0xFFFFFFFF)
    spaced = crc_table()[(a ^ np.uint32(32)) & np.uint32(255)] ^ (a >> np.uint32(8)) \
        ^ np.uint32(0xFFFFFFFF)
    short = size[second] <= _SHORT
    both = np.empty(len(first), dtype=np.uint32)
    both[short] = _shifted(spaced[short], size[second[short]]) ^ crc[second[short]]
    raw = low.data
    for i in np.flatnonzero(~short).tolist():
        w = second[i]
        both[i] = zlib.crc32(raw[start[w]:end[w]], int(spaced[i]))
    bucket = np.concatenate([crc, both]) % np.uint32(BUCKETS)
    return n, n + np.maximum(n - 1, 0), np.concatenate([row, row[first]]), bucket.astype(np.int64)


def _planes(place: np.ndarray, bit: np.ndarray, words: int) -> np.ndarray:
    """``words`` words with the bits of sorted places set where ``bit``."""
    out = np.zeros(words, dtype=np.uint64)
    place = place[bit]
    if len(place):
        word = place >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(
            np.uint64(1) << (place & 63).astype(np.uint64), first)
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(sign, exponent, plane) of all planes of the gains that are not empty."""
    size, place = np.abs(gains), np.arange(len(gains))
    out = []
    for q in range(int(size.max(initial=0)).bit_length()):
        bit = (size >> q & 1).astype(bool)
        for sign in (1, -1):
            plane = _planes(place, bit & (gains * sign > 0), WORDS)
            if plane.any():
                out.append((sign, q, plane))
    return out


def sums(row: np.ndarray, bucket: np.ndarray, n_rows: int,
         gains: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The sum of every row's gains, by planes."""
    key, count = np.unique(row * (64 * WORDS) + bucket, return_counts=True)
    total = np.zeros(n_rows, dtype=np.int64)
    cut = np.searchsorted(key, np.arange(0, n_rows + _ROWS, _ROWS) * (64 * WORDS))
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        place, c = key[a:b] - i * _ROWS * 64 * WORDS, count[a:b]
        rows = min(_ROWS, n_rows - i * _ROWS)
        for p in range(int(c.max(initial=0)).bit_length()):
            plane = _planes(place, (c >> p & 1).astype(bool), rows * WORDS).reshape(rows, WORDS)
            full = np.flatnonzero(plane.any(axis=1))
            plane = plane[full]
            for sign, q, gain in gains:
                ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                total[i * _ROWS + full] += sign * (ones << (p + q))
    return total


def _chunks(batch: pa.RecordBatch):
    buf, off = S.text_buffer(batch.column("text"))
    for a, b in S.chunks(off):
        yield a, b, features(buf[off[a]:off[b]], off[a:b + 1] - off[a])


def bucket_totals(texts: DataFrame) -> DataFrame:
    """bucket, total: features of all texts by bucket.  A task sends one row
    for each of its buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, (_, _, _, bucket) in _chunks(batch):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])],
                                         names=["bucket", "total"])

    return (texts.select(F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "bucket int, total long")
            .groupBy("bucket").agg(F.sum("total").alias("total")))


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket from its totals in both corpora."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (float(source.sum()) + BUCKETS) / ((s + 1) * (float(target.sum()) + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Gains from whole corpora; ``BUCKETS`` rows a corpus reach the driver."""
    def totals(texts: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.int64)
        for r in bucket_totals(texts).collect():
            out[r.bucket] = r.total
        return out

    return gains_of(totals(docs), totals(target))


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_features, weight of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_planes(gains)
        for batch in batches:
            for a, b, (words, n, row, bucket) in _chunks(batch):
                total = sums(row, bucket, b - a, planes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a),
                     pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(total // np.maximum(n, 1))],
                    names=["doc_id", "th", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, th long, n_words long, n_features long, weight long")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def noise(seed: int) -> Column:
    """Gumbel noise from the id's hash, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7,
           min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, n_words, n_features, weight, score, rank of every row."""
    scored = weighted(docs, fit(docs, target)).withColumn("score", F.col("weight") + noise(seed))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "weights")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    may = stored(scored.filter(F.col("n_words") >= min_words).select("row", "doc_id", "score")
                 .repartitionByRange(*order).sortWithinPartitions(*order)
                 .select("row", F.monotonically_increasing_id().alias("place")), "order")
    # a place is the number of its partition, then its number there
    place = may.select("row", F.shiftright("place", 33).alias("part"),
                       F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    parts = place.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    drawn = place.count() * percent // 100
    ranks = (place.join(F.broadcast(base), "part")
             .select("row", (F.col("base") + F.col("nth") + 1).cast("long").alias("rank"))
             .filter(F.col("rank") <= drawn))
    return scored.join(ranks, "row", "left").drop("row")


def digests(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row."""
    return ranked(docs, target, percent, seed).select(
        "doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that are drawn; rows with equal id and text are
    drawn together."""
    taken = (ranked(docs, target, percent, seed).filter("rank is not null")
             .select(F.col("doc_id").alias("taken_id"), F.col("th").alias("taken_th")).distinct())
    own = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("own_id"),
                      text_hash().alias("own_th"))
    return own.join(taken, F.col("own_id").eqNullSafe(F.col("taken_id"))
                    & (F.col("own_th") == F.col("taken_th")), "left_semi").select("whole.*")
