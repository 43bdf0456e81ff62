"""Prefix doubling row by row, against all windows and the sparse plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from statline.llm import prefix_doubling, suffix_dedup

from passages import passages


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    return sorted((r, i) for r, t in enumerate(raw) for i in range(len(t) - length + 1)
                  if n[t[i:i + length]] > 1)


@pytest.mark.parametrize("seed,length", [(0, 200), (1, 45), (2, 7)])
def test_as_all_windows(spark, seed, length):
    rows = passages(seed)
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)],
                               "row long, doc_id long, text string").repartition(4)
    want = brute([t for _, t in rows], length)
    assert sorted(map(tuple, prefix_doubling.repeated(df, length).collect())) == want
    if length == 7:
        return
    # the operator's plan removes the bytes that these strings cover
    covered = Counter(r for r, _ in {(r, i + k) for r, i in want for k in range(length)})
    removed = suffix_dedup.digests(df.withColumn("doc_id", F.col("row")), length).filter("n_removed > 0")
    assert {r.doc_id: r.n_removed for r in removed.collect()} == dict(covered)


def test_empty(spark):
    df = spark.createDataFrame([(0, "short"), (1, None)], "row long, text string")
    assert prefix_doubling.repeated(df, 20).collect() == []
    assert prefix_doubling.repeated(df.filter("row > 5"), 20).collect() == []
