"""Importance resampling against a plain recount."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from statline.llm import queries
from statline.llm import target_resampling as R

SF = "/root/testdata/sf0.001"


def words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    w = words(text)
    return [zlib.crc32(x) % 10000 for x in w] + [
        zlib.crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:])]


def brute(docs, items):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, x in docs:
        np.add.at(s, buckets(x), 1)
    for x in items:
        np.add.at(t, buckets(x), 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000))))
            for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for d, x in docs:
        f = buckets(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None, len(words(x))])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[:25 * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def tables(seed):
    r = random.Random(seed)
    voc = ["The", "a", "É", "日本", "x1", "Ünder", "w", "é" * 30, "z" * 47, "z" * 49, "q" * 200]
    voc += [f"v{i}" for i in range(30)]
    text = lambda n: r.choice([" ", ", ", "\n", "-"]).join(r.choice(voc) for _ in range(n))
    docs = [(d, text(r.choice([0, 1, 5, 19, 20, 21, 60, 200]))) for d in range(120)]
    docs += [(500, None), (501, ""), (502, ".,"), (None, text(40)), (503, "same " * 3000)]
    r.shuffle(docs)
    return docs, [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("seed", [0, 1])
def test_as_recount(spark, seed):
    docs, items = tables(seed)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs],
                              "doc_id long, text string, rank int, th string").repartition(5)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    assert sorted(map(tuple, R.digests(d, b).collect()), key=str) == brute(docs, items)


def test_query_as_recount(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_repeated_rows_are_ranked_apart(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(1, text)] * 40 + [(i, text + f" x{i}") for i in range(2, 62)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    b = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    got = [r.rank for r in R.digests(d, b).collect() if r.rank is not None]
    assert sorted(got) == list(range(1, 26))
    kept = R.drawn(d.withColumn("taken_th", d.doc_id), b)
    assert kept.columns == ["doc_id", "text", "taken_th"] and 0 < kept.count() <= 25 + 40


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b " * 30), (2, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert R.digests(d.filter("doc_id > 5"), b).collect() == []
    got = {r.doc_id: r for r in R.digests(d, b.filter("item_id > 5")).collect()}
    assert got[2].n_features == 0 and got[2].weight == 0 and got[1].rank is None
    assert R.drawn(d, b, percent=100).select("doc_id").collect()[0].doc_id == 1


def test_long_text(spark):
    """Beyond the symbols that are handled at once, alone and among small ones."""
    r = random.Random(3)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(300_000))
    assert len(long) > 1 << 20
    docs = [(1, "a bb ccc"), (2, long), (3, "ddd a"), (4, "x" * (1 << 21))]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(1, "a bb ccc")], "item_id long, text string")
    assert sorted(map(tuple, R.digests(d, b).collect()), key=str) == brute(docs, ["a bb ccc"])


def test_planes_are_exact():
    rng = np.random.default_rng(0)
    gains = rng.integers(-9000, 9000, R.BUCKETS)
    row = np.sort(rng.integers(0, 700, 40_000))
    bucket = rng.choice(np.concatenate([np.zeros(5, int), rng.integers(0, R.BUCKETS, 50)]), 40_000)
    want = np.zeros(700, np.int64)
    np.add.at(want, row, gains[bucket])
    assert (R.sums(row, bucket, 700, R.gain_planes(gains)) == want).all()
