"""Virtual slots: places, balance, versions and rebalancing."""

import zlib
from collections import defaultdict

from statline.llm import sharding
from statline.session import scratch_path


def docs(spark, n=600):
    rows = [(i, "é" * (i * 7919 % 400) if i % 3 else "copy", "x", 5) for i in range(n)]
    rows += [(n, None, "x", 5), (n + 1, "", None, None), (None, "no id", "x", 5), (4, "é" * 30, "x", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, slot string, shard int")


def test_rows_places_and_sizes(spark):
    rows, df = docs(spark)
    got = sharding.shard(df.repartition(4), scratch_path(spark, "map")).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                   for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    places, total = defaultdict(list), defaultdict(int)
    for r in got:
        places[r.shard].append(r.slot)
        total[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert set(places) == set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(total.values()) - min(total.values()) <= 900  # less than the largest record


def test_native_plan(spark):
    _, df = docs(spark)
    plan = sharding.shard(df, scratch_path(spark, "map"))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Python" not in physical and "Arrow" not in physical


def test_versions_and_rebalance(spark):
    _, df = docs(spark)
    rows = sharding.records(df)
    sizes = sharding.slot_sizes(rows)
    first = sharding.first_map(sizes, 40)
    more = sharding.rebalanced(first, sizes, 41)
    moved = [v for v in range(len(first)) if first[v] != more[v]]
    used = [v for v in moved if v in sizes]
    # the new shard's share moves, and a few slots to even out; the rest stays
    assert used and len(used) <= 2 * len(sizes) / 41 + 40
    total = [sum(sizes.get(v, (0, 0))[0] for v, s in enumerate(more) if s == x) for x in range(41)]
    assert max(total) - min(total) <= 900
    fewer = sharding.rebalanced(first, sizes, 39)
    assert max(fewer) == 38
    # at most the slots of the removed shard and a few to even out
    assert sum(a != b for a, b in zip(first, fewer, strict=True)) <= 2 * first.count(39) + 40
    folder = scratch_path(spark, "map")
    sharding.save_map(spark, folder, 1, first, sizes)
    sharding.save_map(spark, folder, 2, more, sizes)
    read = lambda v: {r.vslot: r.shard for r in sharding.load_map(spark, folder, v).collect()}
    assert read(1) == dict(enumerate(first)) and read(2) == dict(enumerate(more)) == read(None)


def test_empty_table(spark):
    _, df = docs(spark, 5)
    assert sharding.shard(df.filter("doc_id > 99"), scratch_path(spark, "map")).collect() == []
