"""Aho-Corasick findings against a plain scan."""

import hashlib
import random
import re

import pytest

from statline.llm import decontaminate


def words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in patterns:
                    hit.update(range(i, i + size))
                    found |= patterns[tuple(w[i:i + size])]
        out.append((d, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None))
                                   .encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    r = random.Random(seed)
    voc = ["The", "a", "É", "日本", "x1", "b-c", "Ünder", "w"] + [f"v{i}" for i in range(15)]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(voc) for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(25)]
    items += [(3, items[4][1]), (30, None), (31, ""), (32, "v1 v2"), (33, "--"), (None, "v3 v4 v5")]
    docs = []
    for d in range(60):
        t = text(r.randint(0, 30))
        if r.random() < 0.5:
            t += " " + (r.choice(items)[1] or "").upper() + " " + text(5)
        docs.append((r.choice([d, d, max(0, d - 1)]), t))
    return docs + [(100, None), (101, ""), (102, " . "), (None, docs[1][1]), docs[2], docs[2]], items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "x", 1) for d, t in docs],
                                  "doc_id long, text string, hits string, th int").repartition(5),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("block", [4_000_000, 700])
@pytest.mark.parametrize("seed", [0, 1])
def test_as_brute_force(spark, seed, block):
    docs, items = tables(seed)
    d, b = frames(spark, docs, items)
    got = sorted(map(tuple, decontaminate.digests(d, b, block_chars=block).collect()), key=str)
    assert got == brute(docs, items)


@pytest.mark.parametrize("block", [4_000_000, 700])
def test_clean_keeps_rows_without_hits(spark, block):
    docs, items = tables(5)
    d, b = frames(spark, docs, items)
    kept = decontaminate.clean(d, b, block_chars=block)
    assert kept.columns == d.columns
    want = sorted((x[0] for x in brute(docs, items) if not x[5]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_empty_tables(spark):
    docs, items = tables(1)
    d, b = frames(spark, docs, items)
    none = decontaminate.digests(d, b.filter("item_id < 0")).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontaminate.digests(d.filter("doc_id < 0"), b).collect() == []


@pytest.mark.parametrize("block", [4_000_000, 100])
def test_items_without_an_id_as_brute_force_and_sql(spark, block):
    import duckdb

    from statline.llm import oracle

    def line(tag):
        return " ".join(f"{tag}{i}" for i in range(12))

    items = [(None, line("a")), (None, line("b")), (4, line("c")), (5, line("b")), (None, None)]
    docs = [(1, "x " + line("a")), (2, line("b") + " y " + line("a")), (3, line("c") + " " + line("a")),
            (4, line("c")), (5, line("d")), (6, None)]
    d, b = frames(spark, docs, items)
    got = sorted(map(tuple, decontaminate.digests(d, b, block_chars=block).collect()))
    con = duckdb.connect()
    for name, rows in (("documents(doc_id BIGINT, text VARCHAR)", docs),
                       ("benchmark(item_id BIGINT, text VARCHAR)", items)):
        con.execute(f"CREATE TABLE {name}")
        con.executemany(f"INSERT INTO {name.split('(')[0]} VALUES (?, ?)", rows)
    assert got == sorted(con.execute(oracle.LEAKS).fetchall())
    # brute() calls the missing id "None"; it counts as an item and leaves the digest
    assert [(*x[:4], x[5]) for x in got] == [(*x[:4], x[5]) for x in brute(docs, items)]
    assert [x[3] for x in got] == [1, 2, 2, 1, 0, 0]
    kept = decontaminate.clean(d, b, block_chars=block)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6]
