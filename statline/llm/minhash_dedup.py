"""Near-duplicate groups by circulant MinHash.

Signatures: one permutation scatters shingles over a ring of ``RING`` places,
a second one gives each place a value; coordinate k is the least value over
the document's places shifted by k around the ring.  So two permutations give
all coordinates, and a document's signature is a running minimum over slices
of one array.  Bands of coordinates make buckets.

A node is a distinct pair of doc_id and text, known by the id and a hash of
the text; nodes are ordered by id (null last), then hash.  Nodes with equal
shingle sets are one class, and classes are numbered in the order of their
smallest nodes; the rest runs on these numbers:

1. In every bucket each class is compared with up to three leaders (the
   smallest class and two chosen by a hash), on full shingle sets.
2. Buckets whose classes then lie in several components are looked at again:
   classes outside the bucket's largest component are compared with all of
   other components, each pair in the first such bucket that it shares.

Neither look compares sets that their sizes or bit sketches keep apart.  A
sketch has a bit for each shingle's slot: a bit that only one of two documents
has is a shingle that the other lacks, so the sketches bound the similarity
from above, and no link is lost.

So every pair of classes in a bucket is compared, excluded, or already in one
component; there is no cap, and pairs within one component are not formed.

The chance that a pair at the threshold shares no bucket is below one in a
million (40 bands of 7 for 0.85; 48 of 6 for 0.8).

Defined cases: null and empty texts and texts without words have an empty set,
are linked with nothing and kept; a text with fewer words than a shingle is
one shingle; rows with equal id and text are one node, and are kept or not
together; rows that share a doc_id or have none, with different texts, are
judged apart; a null doc_id counts as the largest id and stays null, also as a
component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import components, stored

# The ring's values (1 MB) stay in a core's cache.  Shingles that fall on one
# place count once in the signature; the exact comparison knows them apart.
RING_BITS = 18
RING = 1 << RING_BITS
SKETCH_WORDS = 32
SKETCH_BITS = (64 * SKETCH_WORDS - 1).bit_length()
_SIG = "doc_id long, th long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"


@lru_cache(maxsize=1)
def ring(coordinates: int) -> np.ndarray:
    """Values around the ring, continued so that a slice never wraps."""
    values = np.random.default_rng(7).permutation(RING).astype(np.uint32)
    return np.concatenate([values, values[:coordinates]])


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct shingle hashes of every row, sorted, and their offsets."""
    low = S.ascii_lower(buf)
    starts, ends, rows = S.words(low, offsets)
    hasher = S.Hasher(S.word_hashes(low, starts, ends))
    count = np.diff(rows)
    n = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), n)
    at = rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = hasher.ranges(at, np.minimum(at + size, rows[1:][row])) if len(row) else \
        np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    for x, y in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[x:y].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of one non-empty shingle set."""
    coordinates = bands * rows
    slices = np.lib.stride_tricks.sliding_window_view(ring(coordinates), coordinates)
    place = (hashes * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    least = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(place), 2048):
        np.minimum(least, slices[place[i:i + 2048]].min(axis=0), out=least)
    values = least.reshape(bands, rows).astype(np.uint64) + np.uint64(1)
    keys = S.mix((values * S.powers(rows, S.BASE)).sum(axis=1, dtype=np.uint64))
    return S.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(S.INVERSE))


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SKETCH_WORDS`` words of every row: the slots of its shingles, which
    are the first bits of their hashes."""
    out = np.zeros((len(at) - 1) * SKETCH_WORDS, dtype=np.uint64)
    slot = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    word = np.repeat(np.arange(len(at) - 1), np.diff(at)) * SKETCH_WORDS + (slot >> 6)
    if len(word):  # hashes are sorted in each row, so words are in order
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
    return out


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off):
                h, at = shingle_sets(buf[off[a]:off[b]], off[a:b + 1] - off[a], size)
                total = np.concatenate([[0], np.cumsum(h, dtype=np.uint64)]).astype(np.uint64)
                other = np.concatenate([[0], np.cumsum(S.mix(h ^ np.uint64(S.INVERSE)),
                                                       dtype=np.uint64)]).astype(np.uint64)
                keys = [band_keys(h[x:y], bands, rows).view(np.int64) if y > x
                        else np.zeros(0, np.int64)
                        for x, y in zip(at[:-1], at[1:], strict=True)]
                lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                sketch = sketches(h, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a),
                     pa.array(np.diff(at)),
                     pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                     pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)),
                                              pa.array(np.concatenate(keys) if keys else
                                                       np.zeros(0, np.int64))),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(0, len(sketch) + 1, SKETCH_WORDS, dtype=np.int32)),
                         pa.array(sketch.view(np.int64)))],
                    names=["doc_id", "th", "n", "s1", "s2", "bands", "sketch"])
    return sign


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                sets = []
                for name in ("a", "b"):  # a text of several pairs is cut up once
                    _, first, back = np.unique(batch.column(name), return_index=True,
                                               return_inverse=True)
                    buf, off = S.text_buffer(batch.column(f"text_{name}").take(pa.array(first)))
                    parts = [shingle_sets(buf[off[x]:off[y]], off[x:y + 1] - off[x], size)
                             for x, y in S.chunks(off)]
                    own = [h[i:j] for h, at in parts
                           for i, j in zip(at[:-1], at[1:], strict=True)]
                    sets.append([own[i] for i in back])
                both = np.array([len(np.intersect1d(x, y, assume_unique=True))
                                 for x, y in zip(*sets, strict=True)], dtype=np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)],
                                 dtype=np.int64) - both
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(100 * both >= percent * union)],
                    names=["a", "b", "linked"])
    return verify


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(_verifier(size, percent),
                        "a long, b long, linked boolean"))


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _sketches_allow(x: str, y: str, percent: int) -> Column:
    """Upper bound of the similarity from sizes and sketches: a bit that only
    one side has stands for a shingle, at least, that the other side lacks."""
    def lacking(a: str, b: str) -> Column:
        only = [F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{i}"))))
                for i in range(SKETCH_WORDS)]
        return F.col(f"{a}.n") - reduce(lambda p, q: p + q, only)

    common = F.least(lacking(x, y), lacking(y, x))
    return 100 * common >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - common)


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def groups(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 40,
           rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return nodes(docs, size, percent, bands, rows).drop("th")


def nodes(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """The columns of ``groups`` and th, the hash of the row's text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"),
                       F.col("text").cast("string").alias("text"))
    signed = stored(base.mapInArrow(_signer(size, bands, rows), _SIG), "signatures")
    node = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    # sorted, so that the numbers have the order of the smallest nodes
    classes = stored(signed.filter("n > 0").groupBy("s1", "s2", "n")
                     .agg(F.min(node).alias("head"), F.first("bands").alias("bands"),
                          F.first("sketch").alias("sketch"))
                     .orderBy("head").withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    mixed = F.struct(F.xxhash64("rep").alias("h"), "rep", "n")
    leaders = (buckets.groupBy("key").agg(
        F.min(F.struct("rep", "n")).alias("low"), F.min(mixed).alias("first"),
        F.max(mixed).alias("last"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        .select("key", F.array_distinct(F.array(*[
            F.struct(F.col(f"{x}.rep").alias("rep"), F.col(f"{x}.n").alias("n"))
            for x in ("low", "first", "last")])).alias("leaders")))
    members = stored(buckets.join(leaders, "key").select("key", "rep", "n", "leaders"), "buckets")
    wanted = (members.select("rep").distinct().join(classes, "rep")
              .select("rep", F.col("head.doc_id").alias("head_id"), F.col("head.th").alias("th")))
    texts = stored(base.join(wanted, (base["th"] == wanted["th"])
                             & base["doc_id"].eqNullSafe(wanted["head_id"]))
                   .groupBy("rep").agg(F.first("text").alias("text")), "candidates")
    words = [F.col("sketch")[i].alias(f"b{i}") for i in range(SKETCH_WORDS)]
    sketched = classes.select("rep", "n", *words)
    led = members.select("rep", "n", F.explode("leaders").alias("lead"))
    first = (led.filter((F.col("rep") != F.col("lead.rep"))
                        & _sizes_allow(F.col("n"), F.col("lead.n"), percent))
             .select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
             .distinct())
    first = (first.join(sketched.alias("x"), F.col("a") == F.col("x.rep"))
             .join(sketched.alias("y"), (F.col("b") == F.col("y.rep"))
                   & _sketches_allow("x", "y", percent)).select("a", "b"))
    judged = stored(_verified(first, texts, size, percent), "judged")
    links = judged.filter("linked").select("a", "b")
    second = _second_look(members, judged, components(links), sketched, percent)
    more = stored(_verified(second, texts, size, percent).filter("linked").select("a", "b"), "links")
    found = components(links.unionByName(more))
    first_of = classes.select(F.col("rep").alias("comp"), F.col("head").alias("best"))
    best = first_of.join(found.filter("node = comp").select("comp"), "comp")
    of_class = signed.select("doc_id", "th", "n", "s1", "s2").join(
        classes.select("s1", "s2", F.col("n").alias("class_n"), "rep", "head")
        .join(found.join(best, "comp").select("node", "best"), F.col("rep") == F.col("node"), "left")
        .select("s1", "s2", "class_n", F.coalesce("best", "head").alias("best")),
        ["s1", "s2"], "left").filter("class_n is null or class_n = n")
    best = F.coalesce("best", node)
    return of_class.select(
        "doc_id", F.col("n").alias("n_shingles"), best["doc_id"].alias("component_id"),
        (best == node).alias("kept"), "th")


def _second_look(members: DataFrame, judged: DataFrame, found: DataFrame, sketched: DataFrame,
                 percent: int) -> DataFrame:
    """Pairs of one bucket in different components that nothing excludes yet.

    A pair is formed once, in the first open bucket that both classes are in:
    a class carries the open buckets (at most one a band) before each of its
    own."""
    known = members.drop("leaders").join(found, members["rep"] == found["node"], "left").withColumn(
        "comp", F.coalesce("comp", "rep"))
    sizes = stored(known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
                   .agg(F.max_by("comp", F.struct("c", "comp")).alias("main"),
                        F.count(F.lit(1)).alias("comps"))
                   .filter("comps > 1").select("key", "main"), "open_buckets")
    of_class = (known.join(sizes, "key").groupBy("rep").agg(
        F.first("comp").alias("comp"),
        F.sort_array(F.collect_list(F.struct("key", "main"))).alias("open")))
    open_ = stored(of_class.join(sketched, "rep").select(
        "*", F.posexplode("open").alias("at", "own")).select(
            "rep", "n", "comp", F.col("own.key").alias("key"), F.col("own.main").alias("main"),
            F.slice(F.col("open.key"), F.lit(1), F.col("at")).alias("before"),
            *[f"b{i}" for i in range(SKETCH_WORDS)]), "open_classes")
    x, y = open_.filter("comp <> main").alias("x"), open_.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key"))
                   & (F.col("x.comp") != F.col("y.comp"))
                   & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
                   & _sizes_allow(F.col("x.n"), F.col("y.n"), percent)
                   & _sketches_allow("x", "y", percent)
                   & ~F.arrays_overlap("x.before", "y.before"))
    pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"),
                         F.greatest("x.rep", "y.rep").alias("b"))
    return pairs.join(judged, ["a", "b"], "left_anti")
