"""Shared plan of the two exact repeat removers (words: ``fm_index``; bytes:
``suffix_dedup``): find every window of ``length`` symbols that also starts
elsewhere, without ever shuffling all windows.

1. ``runs``: each document is cut into runs of consecutive windows that share
   one content-defined anchor (see ``sequences``); a run is one small row with
   the hash ``h`` of its anchor and ``u`` of all symbols its windows cover.
   About one row per 60 bytes of bytes, or per five words.
2. The runs are dealt out by anchor and sorted by (``h``, ``u``, document).
   One pass over each sorted partition, with a few rows of memory, settles
   most of them (``settle_runs``): an anchor that occurs once proves its
   windows unique, and equal runs are repeats of each other.
3. Only anchors with differing runs (edges of copied passages) need a look at
   symbols.  One run of each kind is cut out of its document, once for all
   its places there, and sent to the shard of its anchor, where the operator's
   own index decides window by window.
4. Covered ranges are gathered per document and joined with the texts.  Both
   joins with ``documents`` use the same exchange, so texts move once, and
   so do the runs.

An anchor with more than ``HOT_KINDS`` kinds of runs would fill a shard: a
common passage whose surroundings always differ.  Its windows are compared by
a 128-bit hash instead, in an aggregation (map-side combined) and a join that
Spark may split, so no task gathers them.

A hot passage is many runs of one anchor.  Each task settles among themselves
the equal runs that it reads (``MapSide``) and sends on one or two of a kind,
so a passage in a third of all rows is a few rows per task in the shuffle;
there they are sorted outside memory and read as a stream, never gathered.

A row of ``documents`` is known by ``doc_id`` and the MD5 of its text, so rows
that repeat an id with another text stay apart; null ids and texts are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import stored

# Symbols of candidate runs indexed at once in a task (whole anchors only).
SHARD_SYMBOLS = 1 << 21
LAST = (1 << 63) - 1
# A run as it is dealt out and sorted, numbers only: th in two halves; first,
# twin, n and done in one.
_RUNS = "doc_id long, h long, u long, th1 long, th2 long, run long"
# A kind of run that stands this often in one chunk is remembered by its task
# (up to a number of kinds), so that later ones need not be sent.
HOT = 8
REMEMBERED = 1 << 16
# Kinds of runs of one anchor that a shard takes; with more, see hot_windows.
HOT_KINDS = 20_000
_CUT = "h long, doc_id long, th binary, firsts array<int>, n int, piece binary"
_RANGES = "doc_id long, th binary, start int, stop int"


def keyed(docs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The columns that the removers use, and ``columns`` packed as ``rest``."""
    rest = [F.struct(*columns).alias("rest")] if columns else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("th"),
                       text.alias("text"), *rest)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["th"].eqNullSafe(b["th"])


class MapSide:
    """Settles equal runs (same ``h`` and ``u``) inside a task, as far as one
    task can know: of a hot passage it sends a row or two, not one for each
    document."""

    def __init__(self, first_wins: bool):
        self.first_wins = first_wins
        self.sent: dict[tuple[int, int], int] = {}

    def __call__(self, h: np.ndarray, u: np.ndarray, place: np.ndarray):
        """Which runs to send on, which are covered for sure, and which of the
        sent have a twin."""
        order = np.argsort(S.mix(h + u * np.uint64(S.BASE)), kind="stable")
        a, b, p = h[order], u[order], place[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        least = np.minimum.reduceat(p, begin)
        silent = np.zeros(len(begin), dtype=bool)
        for k in np.flatnonzero(size >= HOT // 2).tolist():
            key = (int(a[begin[k]]), int(b[begin[k]]))
            known = self.sent.get(key)
            if known is not None:
                silent[k] = not self.first_wins or least[k] > known
            if size[k] >= HOT and len(self.sent) < REMEMBERED and not silent[k]:
                self.sent[key] = int(least[k])
        of = np.cumsum(new) - 1
        send = ((p == least[of]) if self.first_wins else new) & ~silent[of]
        twin = send & (size[of] > 1) & (not self.first_wins)
        out = [np.empty(len(h), dtype=bool) for _ in range(2)]
        for target, source in zip(out, (send, twin), strict=True):
            target[order] = source
        return out[0], ~out[0], out[1]


def run_finder(length: int, k: int, words: bool, first_wins: bool) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_side = MapSide(first_wins)
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            ids, th = batch.column("doc_id"), th_halves(batch.column("th"))
            places = ids.fill_null(LAST).to_numpy()
            for a, b in S.chunks(off):
                offsets, part = off[a:b + 1] - off[a], buf[off[a]:off[b]]
                if words:
                    starts, ends, offsets = S.words(part, offsets)
                    symbols = S.word_hashes(part, starts, ends)
                else:
                    symbols = S.BYTE_VALUES[part]
                hasher = S.Hasher(symbols)
                row, first, last, at, h = S.anchor_runs(hasher, offsets, length, k)
                if not len(row):
                    continue
                n = last - first + 1
                u = S.mix(hasher.ranges(first, last + length)
                          + (n << 32 | (at - first)).astype(np.uint64))
                send, done, twin = map_side(h, u, places[row + a])
                # runs of a row follow each other: covered ones become ranges
                join = np.zeros(len(row), dtype=bool)
                join[1:] = done[1:] & done[:-1] & (row[1:] == row[:-1])
                head = np.flatnonzero(done & ~join)
                total = np.concatenate([[0], np.cumsum(np.where(done, n, 0))])
                stop = np.append(head[1:], len(row))
                pick = np.concatenate([np.flatnonzero(send), head])
                size = np.concatenate([n[send], total[stop] - total[head]])
                local = np.arange(len(pick)) >= send.sum()
                take = pa.array(row[pick] + a)
                halves = th[row[pick] + a]
                run = ((first - offsets[row])[pick] << 33 | twin[pick].astype(np.int64) << 32
                       | size << 1 | local)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.array(h[pick].view(np.int64)),
                     pa.array(u[pick].view(np.int64)), pa.array(halves[:, 0]),
                     pa.array(halves[:, 1]), pa.array(run)],
                    names=["doc_id", "h", "u", "th1", "th2", "run"])
    return find


def th_halves(column: pa.Array) -> np.ndarray:
    """MD5s, 16 bytes each, as two numbers a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, 2)


def th_column(halves: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(halves), [None, pa.py_buffer(np.ascontiguousarray(halves))]
    ).cast(pa.binary())


def unpacked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt runs with the columns that ``settle_runs`` reads."""
    for batch in batches:
        run = batch.column("run").to_numpy()
        th = np.stack([batch.column(c).to_numpy() for c in ("th1", "th2")], axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), th_column(th), pa.array((run >> 33).astype(np.int32)),
             pa.array((run >> 1 & (1 << 31) - 1).astype(np.int32)), batch.column("h"),
             batch.column("u"), pa.array((run >> 32 & 1).astype(bool)),
             pa.array((run & 1).astype(bool))],
            names=["doc_id", "th", "first", "n", "h", "u", "twin", "done"])


_SETTLED = "doc_id long, th binary, first int, n int, h long, u long, wanted boolean"
_SETTLED_NAMES = ["doc_id", "th", "first", "n", "h", "u"]


def _told(part: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
    """Settled rows; only those of wanted runs keep their hash ``u``."""
    u = part.column("u") if wanted else pa.nulls(part.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(part.column(c) for c in _SETTLED_NAMES[:-1]), u,
         pa.array(np.full(part.num_rows, wanted))], names=[*_SETTLED_NAMES, "wanted"])


def settle_runs(first_wins: bool) -> Callable:
    """One pass over runs sorted by h, u, doc_id (a null id is the largest).

    Gives a row with ``wanted`` false for each run whose windows are all
    covered (``first_wins``: an equal run stands in an earlier document;
    else: an equal run stands anywhere else), and with ``wanted`` true for the
    first runs of each kind where an anchor has several kinds.  Between
    batches only the last row and the first kind's first runs are kept.
    """
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        # of the held rows: least place of their kind, a twin anywhere, a twin
        # before them here, already given as covered / as wanted; and whether
        # their anchor has several kinds
        least = np.zeros(0, np.int64)
        twin = after = told = asked = np.zeros(0, bool)
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column("done")
            if done.true_count:
                part = batch.filter(done)
                yield _told(part, False)
                batch = batch.filter(pc.invert(done))
                if not batch.num_rows:
                    continue
            rows = pa.Table.from_batches([batch])
            old = 0 if held is None else held.num_rows
            if old:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            n = rows.num_rows
            h, u = rows["h"].to_numpy(), rows["u"].to_numpy()
            place = rows["doc_id"].fill_null(LAST).to_numpy()
            grow = lambda x, fill: np.concatenate([x, np.full(n - old, fill, x.dtype)])
            least, told, asked = grow(least, 0), grow(told, False), grow(asked, False)
            twin = np.concatenate([twin, np.asarray(batch.column("twin"))])
            group = np.ones(n, bool)
            group[1:] = h[1:] != h[:-1]
            kind = group.copy()
            kind[1:] |= u[1:] != u[:-1]
            begin = np.flatnonzero(kind)
            of_kind = np.cumsum(kind) - 1
            least = np.where(begin < old, least[begin], place[begin])[of_kind]
            first = np.flatnonzero(group)
            kinds = np.add.reduceat(kind.astype(np.int64), first)
            many = kinds > 1
            if old:
                many[0] |= several
            mixed = many[np.cumsum(group) - 1]
            after = grow(after, False)
            after[1:] |= ~kind[1:]
            twin |= after
            if first_wins:
                covered, head = place > least, place == least
            else:
                covered, head = twin.copy(), ~after
                covered[:-1] |= ~kind[1:]
            for mask, wanted in ((covered & ~told, False), (head & mixed & ~asked, True)):
                at = np.flatnonzero(mask)
                if len(at):
                    part = rows.take(pa.array(at)).combine_chunks().to_batches()[0]
                    yield _told(part, wanted)
            told, asked = told | covered, asked | (head & mixed)
            keep = np.zeros(n, bool)
            keep[-1] = True
            keep[first[-1]:] |= (head & ~mixed)[first[-1]:]
            held, several = rows.filter(pa.array(keep)).combine_chunks(), bool(many[-1])
            least, twin, after = least[keep], twin[keep], after[keep]
            told, asked = told[keep], asked[keep]
    return settle


def listed_runs(column: pa.Array):
    """Row, first window, number of windows, h and u of all listed runs of a
    batch, as flat arrays, equal runs of a row next to each other; and which
    of them are the first of their kind in their row."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten()
    first, n, h, u = (np.asarray(flat.field(c)) for c in ("first", "n", "h", "u"))
    row = np.repeat(np.arange(len(column)), lengths)
    key = S.mix(h.view(np.uint64) + u.view(np.uint64) * np.uint64(S.BASE))
    order = np.argsort(S.mix(key + row.astype(np.uint64)), kind="stable")
    row, first, n, h, u = (x[order] for x in (row, first, n, h, u))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    return row, first, n, h, new


def cut_out(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes from each start to its stop, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(stop - start)])
    at = np.repeat(start - offsets[:-1], stop - start) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start),
        [None, pa.py_buffer(offsets), pa.py_buffer(buf[at])]).cast(pa.binary())


def run_cutter(length: int, words: bool) -> Callable:
    """Cuts the listed runs (``runs``: first, n, h, u) out of their texts; equal
    runs of a row are one piece with several places (``firsts``)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = S.text_buffer(batch.column("text"))
            for x, y in S.chunks(at):
                buf, off = whole[at[x]:at[y]], at[x:y + 1] - at[x]
                row, first, n, h, new = listed_runs(batch.column("runs").slice(x, y - x))
                begin = np.flatnonzero(new)
                places = np.append(begin, len(row))
                row, n, h = row[begin], n[begin], h[begin]
                start, last = first[begin].astype(np.int64), first[begin] + n + length - 2
                if words:
                    starts, ends, of = S.words(buf, off)
                    start, stop = starts[of[row] + start], ends[of[row] + last]
                else:
                    start, stop = off[row] + start, off[row] + last + 1
                for a, b in S.chunks(np.concatenate([[0], np.cumsum(stop - start)])):
                    take = pa.array(row[a:b] + x)
                    firsts = pa.ListArray.from_arrays(
                        pa.array((places[a:b + 1] - places[a]).astype(np.int32)),
                        pa.array(first[places[a]:places[b]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[a:b]), batch.column("doc_id").take(take),
                         batch.column("th").take(take), firsts, pa.array(n[a:b]),
                         cut_out(buf, start[a:b], stop[a:b])],
                        names=["h", "doc_id", "th", "firsts", "n", "piece"])
    return cut


_WINDOWS = "doc_id long, th binary, start int, w1 long, w2 long"


def window_cutter(length: int, words: bool) -> Callable:
    """The windows of the listed runs, each as a position and a 128-bit hash."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for i in range(batch.num_rows):
                text = buf[off[i]:off[i + 1]]
                if words:
                    starts, ends, _ = S.words(text, np.array([0, len(text)]))
                    symbols = S.word_hashes(text, starts, ends)
                else:
                    symbols = S.BYTE_VALUES[text]
                at = np.concatenate([np.arange(r["first"], r["first"] + r["n"])
                                     for r in batch.column("runs")[i].as_py()])
                w = [S.Hasher(x).ranges(at, at + length).view(np.int64)
                     for x in (symbols, S.mix(symbols + np.uint64(1)))]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc_id")[i].as_py()] * n, pa.int64()),
                     pa.array([batch.column("th")[i].as_py()] * n, pa.binary()),
                     pa.array(at.astype(np.int32)), pa.array(w[0]), pa.array(w[1])],
                    names=["doc_id", "th", "start", "w1", "w2"])
    return cut


def hot_windows(texts: DataFrame, length: int, words: bool, first_wins: bool) -> DataFrame:
    """Covered windows of the runs of hot anchors, without a shard."""
    place = F.coalesce(F.col("doc_id"), F.lit(LAST))
    windows = texts.mapInArrow(window_cutter(length, words), _WINDOWS)
    found = windows.groupBy("w1", "w2").agg(
        F.count(F.lit(1)).alias("c"), F.min(place).alias("d")).filter("c > 1")
    both = windows.join(found, ["w1", "w2"])
    if first_wins:
        both = both.filter(place > F.col("d"))
    return both.select("doc_id", "th", "start", (F.col("start") + 1).alias("stop"))


def shard_indexer(decide: Callable) -> Callable:
    """Feeds whole anchors of a partition sorted by ``h`` to ``decide`` in
    shards of about ``SHARD_SYMBOLS`` bytes; ``decide(pieces, n, doc_id)``
    gives a flag per window, pieces after pieces."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            n = table["n"].to_numpy()
            pieces = table["piece"].combine_chunks()
            ids = table["doc_id"].fill_null(LAST).to_numpy()
            flags = decide(pieces, n, ids)
            begin = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            # a range also ends where its piece ends
            inner = begin[1:-1][flags[begin[1:-1]] & flags[begin[1:-1] - 1]]
            start = np.sort(np.concatenate([edge[::2], inner]))
            stop = np.sort(np.concatenate([edge[1::2], inner]))
            if not len(start):
                return
            row = np.searchsorted(begin, start, side="right") - 1
            # the range stands at every place of the piece
            firsts = table["firsts"].combine_chunks()
            at = np.asarray(firsts.offsets).astype(np.int64)
            many = np.diff(at)[row]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            base = np.asarray(firsts.values)[np.repeat(at[row], many) + inside]
            base = base - np.repeat(begin[row], many)
            start, stop, row = (np.repeat(x, many) for x in (start, stop, row))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().take(take),
                 table["th"].combine_chunks().take(take),
                 pa.array((start + base).astype(np.int32)),
                 pa.array((stop + base).astype(np.int32))],
                names=["doc_id", "th", "start", "stop"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += batch.column("piece").nbytes
            if size >= SHARD_SYMBOLS:
                whole = pa.concat_tables(held).combine_chunks()
                h = whole["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1], side="left"))
                if cut:
                    yield from settle(whole.slice(0, cut).combine_chunks())
                held = [whole.slice(cut).combine_chunks()]
                size = held[0]["piece"].nbytes
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows:
                yield from settle(whole)
    return index


def covered_ranges(base: DataFrame, length: int, k: int, words: bool, first_wins: bool,
                   decide: Callable, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """Ranges of window starts (``start``, ``stop`` exclusive) per row.

    ``first_wins``: a window counts when it starts in a document with a
    smaller id; otherwise when it starts anywhere else.
    """
    place = F.coalesce(F.col("doc_id"), F.lit(LAST))  # a null id is the largest
    base = base.select("doc_id", "th", "text")
    runs = base.mapInArrow(run_finder(length, k, words, first_wins), _RUNS)
    # rows that a task has settled need no partner: they go anywhere
    deal = F.when(F.col("run") % 2 != 0, F.xxhash64("doc_id", "run")).otherwise(F.col("h"))
    settle = settle_runs(first_wins)
    settled = (runs.repartition(deal).sortWithinPartitions("h", "u", place, "th1", "th2", "run")
               .mapInArrow(lambda batches: settle(unpacked_runs(batches)), _SETTLED))
    settled = stored(settled, "settled_runs")  # few rows, read by several branches
    asked = settled.filter("wanted").select("doc_id", "th", "first", "n", "h", "u")
    # at most one row for every ``hot_kinds`` of them
    crowded = asked.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter(
        F.col("kinds") > hot_kinds)
    asked = asked.join(F.broadcast(crowded), "h", "left")
    run = F.struct("first", "n", "h", "u", F.col("kinds").isNotNull().alias("hot"))
    wanted = asked.groupBy("doc_id", "th").agg(F.collect_set(run).alias("all_runs"))

    def texts_with(which: Callable[[Column], Column]) -> DataFrame:
        some = wanted.filter(F.exists("all_runs", which))
        return base.join(some, same_row(base, some)).select(
            base["doc_id"], base["th"], base["text"],
            F.filter(some["all_runs"], which).alias("runs"))

    pieces = texts_with(lambda r: ~r["hot"]).mapInArrow(run_cutter(length, words), _CUT)
    checked = (pieces.repartition("h").sortWithinPartitions("h")
               .mapInArrow(shard_indexer(decide), _RANGES))
    crowd = hot_windows(texts_with(lambda r: r["hot"]), length, words, first_wins)
    covered = settled.filter("not wanted").select(
        "doc_id", "th", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop"))
    return covered.unionByName(checked).unionByName(crowd)


def with_ranges(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of ``base`` with the list of its ranges (null: none)."""
    lists = ranges.groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return base.join(lists, same_row(base, lists), "left").select(
        *[base[c] for c in base.columns], lists["ranges"])


def range_arrays(column: pa.Array):
    """Row, start and stop of all ranges of a batch, as flat arrays."""
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), lengths)
    return row, np.asarray(flat.field("start")).astype(np.int64), \
        np.asarray(flat.field("stop")).astype(np.int64)


def cover(n: int, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray,
          length: int) -> np.ndarray:
    """Symbols that lie in a window starting in [start, stop) of their row."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, offsets[row] + start, 1)
    np.add.at(step, offsets[row] + stop + length - 1, -1)
    return np.cumsum(step)[:n] > 0


def unpacked(marked: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """The finished rows with the columns of ``rest`` beside their own."""
    if "rest" not in marked.columns:
        return marked.mapInArrow(finish, schema)
    rest = marked.schema["rest"].dataType
    out = marked.mapInArrow(finish, f"{schema}, rest {rest.simpleString()}")
    return out.select(*[c for c in out.columns if c != "rest"], "rest.*")
