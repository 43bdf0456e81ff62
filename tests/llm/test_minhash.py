"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest

from statline.llm import minhash_dedup
from statline.llm.components import components


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    big = 1 << 62
    out = []
    for i, (d, _) in enumerate(rows):
        comp = min((big if rows[j][0] is None else rows[j][0])
                   for j in range(len(rows)) if find(j) == find(i))
        comp = None if comp == big else comp
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=str)


def texts(seed, n=160):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(80)] + ["É", "The", "a"]
    rows = []
    for d in range(n):
        if rows and r.random() < 0.7:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(voc)
        else:
            w = [r.choice(voc) for _ in range(r.choice([0, 1, 2, 5, 30, 60, 120]))]
        t = " ".join(w)
        rows.append((d * 3 % 487, t.upper() if r.random() < 0.2 and t.isascii() else t))
    return rows + [(1000, None), (1001, " \n"), (None, rows[7][1] or "x y z"), (1002, rows[9][1] + "\n")]


@pytest.mark.parametrize("seed,size,percent,bands,rows_", [(0, 3, 85, 40, 7), (1, 5, 80, 48, 6)])
def test_as_all_pairs(spark, seed, size, percent, bands, rows_):
    rows = texts(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows],
                               "doc_id long, text string, n int, place int").repartition(5)
    got = sorted(map(tuple, minhash_dedup.groups(df, size, percent, bands, rows_).collect()), key=str)
    assert got == brute(rows, size, percent)


def test_chain_through_near_misses(spark):
    """A chain whose ends are not alike is one group, found from any leader."""
    w = [f"x{i}" for i in range(200)]
    rows = []
    for d in range(12):
        v = list(w)
        for i in range(d * 8):
            v[i] = f"y{i}"
        rows.append((50 - d, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, minhash_dedup.groups(df).collect()), key=str)
    assert got == brute(rows, 3, 85)
    assert len({r[2] for r in got}) == 1


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert sorted(map(tuple, minhash_dedup.groups(df).collect())) == [(1, 2, 1, True), (2, 2, 2, True)]
    assert minhash_dedup.groups(df.filter("doc_id > 5")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


def test_circulant_coordinates_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    same = (minhash_dedup.band_keys(a, 400, 1) == minhash_dedup.band_keys(b, 400, 1)).mean()
    assert abs(same - 400 / 600) < 0.12


def test_null_and_repeated_ids_with_different_texts(spark):
    def line(tag, changed=0):
        return " ".join([f"{tag}{i}" for i in range(60 - changed)] + [f"z{i}" for i in range(changed)])

    last = (1 << 63) - 1
    rows = [(5, line("a")), (None, line("a", 1)), (None, line("b")), (None, line("c")),
            (None, line("c", 1)), (3, line("d")), (7, line("e")), (7, line("d")), (None, ""),
            (None, None), (last, line("f")), (None, line("f", 1)), (7, line("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash_dedup.nodes(df, 3, 85, 40, 7).join(
        df.select("doc_id", "text", minhash_dedup.text_hash().alias("th")).distinct()
        .withColumnRenamed("doc_id", "own"), "th").filter("doc_id <=> own")
    got = [(r.doc_id, r.text, r.component_id, r.kept) for r in got.collect()]
    assert len(got) == len(rows)
    c = [x for x in got if x[1] in (line("c"), line("c", 1))]
    assert [x[2] for x in c] == [None, None] and sorted(x[3] for x in c) == [False, True]
    want = [(5, line("a"), 5, True), (None, line("a", 1), 5, False), (None, line("b"), None, True),
            (3, line("d"), 3, True), (7, line("d"), 3, False), (None, "", None, True),
            (None, None, None, True), (last, line("f"), last, True),
            (None, line("f", 1), last, False)] + [(7, line("e"), 7, True)] * 2
    assert sorted((x for x in got if x not in c), key=str) == sorted(want, key=str)
