"""Exact repeat removal (bytes and words) against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statline.llm import fm_index, suffix_dedup
from statline.llm import sequences as S

from passages import passage_rows  # noqa: F401  (a fixture)

SCHEMA = "doc_id long, text string, th string, first string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, "en") for d, t in rows], SCHEMA).repartition(5)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_bytes(rows, length):
    seen, texts = defaultdict(int), [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] += 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    last = 1 << 63
    first = {}
    texts = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, w in texts:
        gone = [0] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < (last if d is None else d):
                gone[i:i + length] = [1] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [200, 30])
def test_bytes_as_brute_force(spark, passage_rows, length):
    got = sorted_rows(suffix_dedup.digests(frame(spark, passage_rows), length))
    assert got == brute_bytes(passage_rows, length)


@pytest.mark.parametrize("length", [13, 4])
def test_words_as_brute_force(spark, passage_rows, length):
    got = sorted_rows(fm_index.digests(frame(spark, passage_rows), length))
    assert got == brute_words(passage_rows, length)


@pytest.mark.parametrize("hot_kinds", [0, 2])
def test_crowded_anchors_need_no_shard(spark, passage_rows, hot_kinds):
    """Anchors with many kinds of runs, compared by window hashes: same result."""
    df = frame(spark, passage_rows)
    assert sorted_rows(suffix_dedup.digests(df, hot_kinds=hot_kinds)) == brute_bytes(passage_rows, 200)
    assert sorted_rows(fm_index.digests(df, hot_kinds=hot_kinds)) == brute_words(passage_rows, 13)


def test_empty_table(spark):
    none = frame(spark, [(1, "x")]).filter("doc_id > 1")
    assert suffix_dedup.digests(none).collect() == []
    assert fm_index.digests(none).collect() == []


def test_remaining_text_drops_broken_characters(spark):
    a = "é" * 150
    rows = [(1, "q" + a + " tail"), (2, a + " end")]
    got = {r.doc_id: r.kept for r in suffix_dedup.remaining(frame(spark, rows)).collect()}
    assert got == {1: "qtail", 2: "end"} or all("é" not in t for t in got.values())


def test_prefix_doubling_on_periodic_text():
    buf = np.frombuffer(b"ab" * 40 + b"abcab", np.uint8)
    found = suffix_dedup.repeated_windows(buf, np.array([0, len(buf)]), 20)
    raw = buf.tobytes()
    want = [raw.count(raw[i:i + 20]) > 0 and len([j for j in range(len(raw) - 19)
            if raw[j:j + 20] == raw[i:i + 20]]) > 1 if i + 20 <= len(raw) else False
            for i in range(len(raw))]
    assert found.tolist() == want


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = fm_index.WaveletMatrix(s, 37)
    sym, pos = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert w.rank(sym, pos).tolist() == [int((s[:p] == c).sum()) for c, p in zip(sym, pos)]


@pytest.mark.parametrize("first_wins", [True, False])
@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_settling_does_not_depend_on_batches(first_wins, size):
    import pyarrow as pa

    from statline.llm.repeats import settle_runs

    rng = np.random.default_rng(size)
    n = 400
    h, u = rng.integers(0, 25, n), rng.integers(0, 4, n)
    u = np.where(h % 3 == 0, 1, u)
    place = rng.integers(0, 12, n)
    order = np.lexsort((place, u, h))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(place[order]), pa.array(np.zeros(n, np.int32)),
         pa.array(np.arange(n, dtype=np.int32)), pa.array(np.ones(n, np.int32)),
         pa.array(h[order]), pa.array(u[order]), pa.array(place[order]),
         pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))],
        names=["doc_id", "th", "first", "n", "h", "u", "place", "twin", "done"])

    def run(batches):
        return sorted((r["first"], r["wanted"]) for b in settle_runs(first_wins)(iter(batches))
                      for r in b.to_pylist())

    got = run([batch.slice(i, size) for i in range(0, n, size)])
    assert got == run([batch])
    h, u, place = h[order], u[order], place[order]
    want = []
    for i in range(n):
        same = (h == h[i]) & (u == u[i])
        several = len(set(u[h == h[i]])) > 1
        least = place[same].min()
        covered = place[i] > least if first_wins else same.sum() > 1
        head = place[i] == least if first_wins else i == np.flatnonzero(same)[0]
        want += [(i, False)] * bool(covered) + [(i, True)] * bool(head and several)
    assert got == sorted(want)


def test_hot_groups_are_settled_in_their_tasks(spark, passage_rows):
    """Many copies and a common passage, in many small batches of one task."""
    common = " ".join(f"c{i}" for i in range(45))
    rows = passage_rows + [(200 + i, f"x{i} {common} y{i}") for i in range(60)]
    rows += [(300 + i % 50, " ".join(f"k{j}" for j in range(80))) for i in range(70)]
    rows += [(50, common + " z"), (299, " ".join(f"k{j}" for j in range(90)))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        df = frame(spark, rows).coalesce(2)
        assert sorted_rows(suffix_dedup.digests(df)) == brute_bytes(rows, 200)
        assert sorted_rows(fm_index.digests(df)) == brute_words(rows, 13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("first_wins", [True, False])
def test_map_side_sends_few_rows_of_a_hot_kind(first_wins):
    from statline.llm.repeats import MapSide

    side, sent = MapSide(first_wins), 0
    for i in range(30):
        h = np.full(40, 7, np.uint64)
        send, done, _ = side(h, h + np.uint64(1), np.arange(40) + 40 * i)
        assert (send ^ done).all()
        sent += send.sum()
    assert sent == 1


def test_texts_of_one_id_with_equal_32_bit_hashes(spark):
    """Spark's hash() of the first two texts is the same; only one has a repeat."""
    shared, clean = " ".join(f"s{i}" for i in range(60)), " ".join(f"c{i}" for i in range(70))
    for d in (7, None):
        rows = [(d, f"n13191 {shared}"), (d, f"m16298 {clean}"), (1, f"x {shared}")]
        df = frame(spark, rows)
        assert {r[0] for r in df.filter("text not like 'x %'").selectExpr("hash(text)").collect()} == {-1550384630}
        assert sorted_rows(suffix_dedup.digests(df)) == brute_bytes(rows, 200)
        assert sorted_rows(fm_index.digests(df)) == brute_words(rows, 13)


def test_equal_runs_of_a_row_are_cut_once():
    """Repeats inside a document go to the shard once, with all their places."""
    from statline.llm.repeats import run_cutter, shard_indexer

    words = " ".join(["lorem"] * 60 + ["ipsum"])
    runs = [{"first": i, "n": 1, "h": 5, "u": 9} for i in range(1, 41)]
    other = [{"first": 48, "n": 1, "h": 5, "u": 8}, {"first": 2, "n": 1, "h": 5, "u": 9}]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([9, None, 8]), pa.array([b"a" * 16, b"b" * 16, b"c" * 16]),
         pa.array(["é\t" + words, "none", words]), pa.array([runs, [], other])],
        names=["doc_id", "th", "text", "runs"])
    cut = [b.slice(i, 1) for b in run_cutter(13, True)(iter([batch])) for i in range(b.num_rows)]
    rows = [r for b in cut for r in b.to_pylist()]
    same, edge = " ".join(["lorem"] * 13).encode(), " ".join(["lorem"] * 12 + ["ipsum"]).encode()
    assert sorted((r["doc_id"], sorted(r["firsts"]), r["piece"]) for r in rows) == [
        (8, [2], same), (8, [48], edge), (9, list(range(1, 41)), same)]
    ranges = [r for b in shard_indexer(fm_index.decider(13))(iter(cut)) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["start"], r["stop"]) for r in ranges) == [
        (9, i, i + 1) for i in range(1, 41)]


def test_kept_words_are_joined_row_by_row():
    texts = ["  one two\tthree ", "", "four", "\n", "five  six", "séven eight"]
    for drop in ([], [0, 2], [1, 3], [4, 5], [5, 6], list(range(8))):
        buf, off = S.text_buffer(pa.array(texts))
        begin, end, words = S.words(buf, off)
        keep = ~np.isin(np.arange(len(begin)), drop)
        raw, at = fm_index.joined(buf, begin, end, words, keep)
        spans, want = [w for t in texts for w in t.split()], []
        for a, b in zip(words[:-1], words[1:], strict=True):
            want.append(" ".join(spans[i] for i in range(a, b) if keep[i]).encode())
        assert [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_suffix_order_sorts_by_the_next_symbols():
    rng = np.random.default_rng(3)
    for n, size, depth in ((1, 1, 14), (50, 2, 14), (300, 3, 5), (400, 200, 14), (64, 1, 14)):
        s = rng.integers(0, size, n)
        order = fm_index.suffix_order(s, depth)
        heads = [s[i:i + depth].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
