"""Whitening against a dense eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from statline.llm import queries
from statline.llm import whitening as W

SF = "/root/testdata/sf0.01"
SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                     StructField("n", IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)


def want(rows):
    """(vec_id, x) of the rows that remain, and n, sums, eigenvalues, vectors."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    u = np.unique(np.stack([x for _, x in kept]), axis=0)
    c = u - u.mean(axis=0)
    e, vec = np.linalg.eigh(c.T @ c / len(u))
    return kept, u, e[::-1], vec[:, ::-1]


def check(got, rows, first):
    kept, u, e, vec = want(rows)
    assert len(got) == len(kept) * first
    s = u.sum(axis=0)
    by = {}
    for i, x in kept:
        by.setdefault((i, tuple(x.tolist())), 0)
        by[i, tuple(x.tolist())] += 1
    known = {}
    for (i, x) in by:
        known.setdefault(i, []).append(np.array(x))
    signs = {}
    for r in got:
        assert r.n == len(u) and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        assert 0 <= r.identity_error < 1e-9
        fits = False
        for x in known[r.vec_id]:
            dev = int(((len(u) * x.astype(object) - s) ** 2).sum())
            y = float((x - s / len(u)) @ vec[:, r.component - 1] / np.sqrt(e[r.component - 1]))
            if r.deviation == dev and abs(abs(r.whitened) - abs(y)) < 1e-8:
                fits = True
                if abs(y) > 1e-3:
                    signs.setdefault(r.component, set()).add(np.sign(y) == np.sign(r.whitened))
        assert fits, r
    assert all(len(v) == 1 for v in signs.values())


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.linspace(0.5, 2, d) @ rng.normal(size=(d, d)) / d
    return [(int(i), [float(np.float32(c)) for c in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("n,d,parts", [(300, 16, 7), (5, 8, 3), (200, 3, 40)])
def test_as_dense(spark, n, d, parts):
    rows = vectors(n, n, d)
    rows += [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d),
             (1004, [float("inf")] + [0.0] * (d - 1)), (3, rows[4][1]), (1005, [0.1] * (d + 1))]
    rows += [(2000 + i, rows[0][1]) for i in range(n // 2)]
    got = W.whitened(frame(spark, rows).repartition(parts)).collect()
    rows = [r for r in rows if r[0] != 1005]
    check(got, rows, min(4, d, n - 1))


def test_query_as_dense(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows, 4)


def test_degenerate_tables(spark):
    rows = vectors(1, 4, 5)
    assert W.whitened(frame(spark, rows).filter("vec_id > 9")).collect() == []
    assert W.whitened(frame(spark, [(i, [0.5, 1.0]) for i in range(6)])).collect() == []
    assert W.whitened(frame(spark, [(1, None), (2, [])])).collect() == []
    line = [(i, [float(i), float(2 * i), 0.25]) for i in range(9)] + [(None, [1.0, 2.0, 0.25])]
    got = W.whitened(frame(spark, line)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1}
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


@pytest.mark.parametrize("d,kind", [(12, "spread"), (12, "equal"), (9, "sparse"), (1, "spread")])
def test_rank_one_steps(d, kind):
    rng = np.random.default_rng(d)
    x = rng.integers(-300, 300, (400, d))
    if kind == "equal":  # axes: equal eigenvalues all along
        x = np.concatenate([np.eye(d, dtype=int) * 100, -np.eye(d, dtype=int) * 100])
    if kind == "sparse":
        x[:, 4:] = 0
        x[:, 3] = x[:, 1]
    parts = [W.Spectrum(d) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    whole = W.Spectrum(d)
    for p in [parts[0], W.Spectrum(d), parts[1], parts[2]]:
        whole.merge(W.Spectrum.of(p.row()))
    c = x - x.mean(axis=0)
    scatter = c.T @ c
    back = whole.vectors * whole.values @ whole.vectors.T
    assert whole.n == len(x) and (whole.sum == x.sum(axis=0)).all()
    assert np.abs(back - scatter).max() < 1e-9 * np.abs(scatter).max()
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(d)).max() < 1e-11


def test_secular_roots():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        d = np.sort(rng.random(n) * 10.0 ** rng.integers(-3, 6))
        z2 = rng.random(n) * 10.0 ** rng.integers(-8, 4, n)
        near, x = W.secular_roots(d, z2, 0.7, 8 * W._EPS)
        e = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.abs(d[near] + x - e).max() < 1e-12 * max(1, e.max())


def test_large_deviation():
    w = W.Whitening(3_000_000_000, np.array([0, 5]), np.eye(2), np.ones(2), 2.0, 0.0)
    x = np.array([[100, -100], [1, 0]])
    assert w.deviation(x)[0] is None
    assert w.deviation(x)[1] is None or w.deviation(x)[1] == 3_000_000_000**2 + 25
