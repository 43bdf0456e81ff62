"""Roster enumeration: counts against a brute-force product in Python."""

import itertools

import pytest

from statline.functions.positions import FLEX
from statline.operators import rosters as R

TOP = "slot string, rank int, player_id string, mean double, variance double"


def _top(spark, groups):
    rows = []
    for slot, players in groups.items():
        for i, (p, m) in enumerate(players):
            rows.append((slot, i + 1, p, m, m / 2))
    return spark.createDataFrame(rows, TOP)


GROUPS = {
    "QB": [("q1", 1.0), ("q2", 2.0)],
    "RB": [("r1", 3.0), ("r2", 1.5), ("r3", 0.5)],
    "WR": [("w1", 2.0), ("w2", 1.0), ("w3", 4.0)],
    "K": [("k1", 0.5)],
    "DEF": [("d1", 1.0), ("d2", 0.25)],
    "TE": [("t1", 2.5), ("r1", 3.0)],
    FLEX: [("w1", 2.0), ("t1", 2.5), ("r1", 3.0), ("w3", 4.0)],
}


def _brute(strict, unordered):
    g = GROUPS
    out = []
    for qb, rb1, rb2, wr1, wr2, k, de, te, fl in itertools.product(
            g["QB"], g["RB"], g["RB"], g["WR"], g["WR"], g["K"], g["DEF"], g["TE"], g[FLEX]):
        ids = [x[0] for x in (qb, rb1, rb2, wr1, wr2, k, de, te, fl)]
        if unordered:
            if not (rb1[0] < rb2[0] and wr1[0] < wr2[0]):
                continue
        elif rb1[0] == rb2[0] or wr1[0] == wr2[0]:
            continue
        if fl[0] in (rb1[0], rb2[0], wr1[0], wr2[0]):
            continue
        if strict and te[0] == fl[0]:
            continue
        mean = 0.0
        for x in (qb, rb1, rb2, wr1, wr2, k, de, te, fl):
            mean += x[1]
        out.append((ids[0], ids[1], ids[2], ids[3], ids[4], ids[7], ids[5], ids[8], ids[6], mean))
    return sorted(out)


def test_rosters_match_brute_force(spark):
    top = _top(spark, GROUPS)
    for strict in (True, False):
        for unordered in (False, True):
            got = sorted((r.qb, r.rb1, r.rb2, r.wr1, r.wr2, r.te, r.k, r.flex, r["def"],
                          r.meanTotal) for r in R.rosters(top, strict, unordered).collect())
            assert got == _brute(strict, unordered)


def test_bound_is_enforced(spark):
    # ranks beyond k are ignored, so the output never exceeds the bound
    big = {g: [(f"{g}{i}", float(i)) for i in range(12)] for g in GROUPS}
    assert R.max_rosters() == 750_000
    n = R.rosters(_top(spark, big), strict=False).count()
    assert 0 < n <= R.max_rosters()


def test_empty_group_gives_no_rosters(spark):
    groups = dict(GROUPS)
    groups["K"] = []
    assert R.rosters(_top(spark, groups)).count() == 0


def test_one_lazy_plan_without_joins(spark):
    plan = R.rosters(_top(spark, GROUPS))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert "RoundRobinPartitioning" in plan  # the product is spread over tasks


def test_too_large_products_are_refused(spark):
    many = {g: 100 for g in GROUPS}
    with pytest.raises(ValueError, match="limit"):
        R.rosters(_top(spark, GROUPS), top_k=many)


def test_strict_rosters_never_repeat_a_player(spark):
    from pyspark.sql import functions as F

    from statline.plans.registry import queries
    from shared_tables import SF_SMALL
    df = queries()["rosters"](spark, SF_SMALL)
    ids = F.array(*[F.col(c) for c in R.OUTPUT])
    bad = df.filter(F.size(F.array_distinct(ids)) != len(R.OUTPUT)).count()
    assert df.count() > 0 and bad == 0
