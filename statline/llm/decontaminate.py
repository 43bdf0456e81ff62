"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised (A-Z lower-cased, words of ASCII letters,
digits and all other Unicode bytes, one space between) and every window of
``WINDOW`` words becomes a pattern; an item with fewer words is one pattern.
The automaton scans each normalised text once, and the ends of its matches are
mapped back to words, and words to bytes of the original text.

The patterns travel to the tasks in blocks of at most ``BLOCK_CHARS``
characters (some 100 MB of automaton each).  One block is the usual case; a
larger benchmark is scanned block by block and the findings are merged, so no
item is left out and a task's memory does not grow with the benchmark.

Defined cases: null and empty texts have no words, are clean, and give the
digest of the empty string; a null item text or an item without words has no
window; items that share an item_id count once; items without an item_id are
searched like others, and together count as one item in ``n_items`` and are
left out of ``items_sha256``; rows that repeat a doc_id are judged apart; an
empty benchmark finds nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S

WINDOW = 10
BLOCK_CHARS = 4_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def normalised(buf: np.ndarray, offsets: np.ndarray):
    """Word spans of every row, and one byte string in which each word stands
    between single spaces (rows are two spaces apart) with the place of the
    space after each word."""
    low = S.ascii_lower(buf)
    starts, ends, rows = S.spans_of(_WORD[low], offsets)
    length = ends - starts
    opens = np.zeros(len(starts), dtype=np.int64)
    opens[rows[:-1][np.diff(rows) > 0]] = 1
    after = np.cumsum(length + 1 + opens) - 1
    out = np.full(int(after[-1]) + 1 if len(after) else 0, 0x20, dtype=np.uint8)
    step = np.repeat(after - length - np.concatenate([[0], np.cumsum(length)[:-1]]), length) \
        if len(after) else np.zeros(0, np.int64)
    place = step + np.arange(int(length.sum()))
    source = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) \
        + np.arange(int(length.sum())) if len(after) else place
    out[place] = low[source]
    return starts, ends, rows, out.tobytes(), after


def blocks_of(benchmark: DataFrame, window: int = WINDOW,
              block_chars: int = BLOCK_CHARS) -> Iterator[dict[str, list]]:
    """Patterns (with the ids of their items), block after block.

    Items are streamed to the driver a partition at a time; no more than one
    block is built at once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            F.col("text").cast("string").alias("text")).dropna(subset=["text"]).distinct()
    block: dict[str, list] = {}
    chars = 0
    for item in rows.orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer(item.text.encode(), np.uint8)
        starts, ends, _, _, _ = normalised(raw, np.array([0, len(raw)]))
        low = S.ascii_lower(raw).tobytes()
        words = [low[a:b].decode("latin-1") for a, b in zip(starts, ends, strict=True)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            pattern = f" {' '.join(words[i:i + window])} "
            if pattern not in block:
                if chars + len(pattern) > block_chars and block:
                    yield block
                    block, chars = {}, 0
                block[pattern] = []
                chars += len(pattern)
            if not block[pattern] or block[pattern][-1] != item.item_id:
                block[pattern].append(item.item_id)
    if block:
        yield block


_AUTOMATA: dict[str, tuple] = {}


def automaton(patterns: dict[str, list], name: str):
    """The automaton of a block, built once per Python worker (one is kept)."""
    if name not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        found = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            found.add_word(p, (i, p.count(" ") - 1))
        found.make_automaton()
        _AUTOMATA[name] = (found, list(patterns.values()))
    return _AUTOMATA[name]


def scan(buf: np.ndarray, offsets: np.ndarray, patterns: dict[str, list], name: str):
    """Word spans, hit words (true), and the items of each row."""
    starts, ends, rows, text, after = normalised(buf, offsets)
    items: dict[int, set] = {}
    step = np.zeros(len(starts) + 1, dtype=np.int64)
    if patterns and text:
        found, owners = automaton(patterns, name)
        matches = [(end, *v) for end, v in found.iter(text.decode("latin-1"))]
        if matches:
            end, pattern, size = np.array(matches, dtype=np.int64).T
            last = np.searchsorted(after, end)
            np.add.at(step, last - size + 1, 1)
            np.add.at(step, last + 1, -1)
            row = np.searchsorted(rows, last, side="right") - 1
            for r, p in set(zip(row.tolist(), pattern.tolist(), strict=True)):
                items.setdefault(r, set()).update(owners[p])
    hit = np.cumsum(step)[:-1] > 0
    return starts, ends, rows, hit, items


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and a hash of its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(text).alias("th"), text.alias("text"))


_FOUND = "n_words long, hits array<struct<first: int, last: int>>, items array<string>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _scanner(patterns: dict[str, list], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off):
                _, _, rows, hit, items = scan(buf[off[a]:off[b]], off[a:b + 1] - off[a],
                                              patterns, name)
                hits: list = [[] for _ in range(b - a)]
                if hit.any():
                    begin = hit.copy()
                    begin[1:] &= ~hit[:-1]
                    inner = rows[(rows > 0) & (rows < len(hit))]
                    begin[inner] = hit[inner]
                    stop = hit.copy()
                    stop[:-1] &= ~hit[1:]
                    stop[inner - 1] = hit[inner - 1]
                    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
                    row = np.searchsorted(rows, first, side="right") - 1
                    for r, x, y in zip(row.tolist(), (first - rows[row]).tolist(),
                                       (last - rows[row]).tolist(), strict=True):
                        hits[r].append({"first": x, "last": y})
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("th")]
                    + [pa.array(np.diff(rows)), pa.array(hits, _HITS),
                       pa.array([sorted(items.get(i, ()), key=lambda x: (x is None, x))
                                 for i in range(b - a)],
                                pa.list_(pa.string()))],
                    names=["doc_id", "th", "n_words", "hits", "items"])
    return run


def _name(block: dict[str, list]) -> str:
    return hashlib.sha256("\n".join(f"{p}{i}" for p, i in block.items()).encode()).hexdigest()


def findings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
             block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_words, hits (ranges of words) and
items (sorted, null last) of every row."""
    base, schema = _keyed(docs), f"doc_id long, th long, {_FOUND}"
    out = None
    for block in blocks_of(benchmark, window, block_chars):
        part = base.mapInArrow(_scanner(block, _name(block)), schema)
        if out is None:
            out = part
            continue
        # later blocks send only their findings through a join; equal rows have
        # equal findings
        more = (part.filter(F.size("items") > 0).groupBy("doc_id", "th")
                .agg(F.first("hits").alias("more_hits"), F.first("items").alias("more_items")))
        out = out.join(more, out["doc_id"].eqNullSafe(more["doc_id"])
                       & out["th"].eqNullSafe(more["th"]), "left").select(
            out["doc_id"], out["th"], out["n_words"],
            F.when(F.col("more_hits").isNull(), F.col("hits"))
            .otherwise(F.concat("hits", "more_hits")).alias("hits"),
            F.when(F.col("more_items").isNull(), F.col("items"))
            .otherwise(F.array_sort(F.array_union("items", "more_items"))).alias("items"))
    return base.mapInArrow(_scanner({}, ""), schema) if out is None else out


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    n_hit = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda x: F.sequence(x["first"], x["last"]))))).cast("long")
    return findings(docs, benchmark, window, block_chars).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows without any hit, all columns kept (``text`` must be a string)."""
    for block in blocks_of(benchmark, window, block_chars):
        name = _name(block)

        def run(batches: Iterator[pa.RecordBatch], block=block, name=name):
            for batch in batches:
                buf, off = S.text_buffer(batch.column("text"))
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, b in S.chunks(off):
                    items = scan(buf[off[a]:off[b]], off[a:b + 1] - off[a], block, name)[4]
                    keep[[a + r for r in items]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
