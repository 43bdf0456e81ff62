"""Positions and top players: the reference's second unit test, extended."""

from pyspark.sql import functions as F

from statline.functions.positions import TOP_K
from statline.operators import positions as P
from statline.operators import stats as ST
from statline.operators import topk as T

STAT = "player_id string, season int, games long, passing_mean double, " \
       "passing_variance double, rushing_mean double, rushing_variance double, " \
       "receiving_mean double, receiving_variance double, total_mean double, " \
       "total_variance double"


def test_reference_fixture(spark):
    # The rows of the reference's test and its expected positions.
    stats = spark.createDataFrame(
        [(p, 2014, 2, 0.0, 0.0, 1.0, 0.0, 2.0, 2.0, 3.0, 2.0) for p in "ABC"], STAT)
    players = spark.createDataFrame([("A", "RB"), ("B", "RB"), ("C", "DB")],
                                    "player string, pos1 string")
    norm = P.normalized_positions(players)
    assert dict(norm.collect()) == {"A": "RB", "B": "RB", "C": "DEF"}
    groups = P.position_groups(ST.player_yearly_stats(stats), norm, 2014)
    top = T.top_players(groups)
    by_slot = {}
    for r in top.collect():
        by_slot.setdefault(r.slot, set()).add(r.player_id)
    assert by_slot == {"RB": {"A", "B"}, "DEF": {"C"}, "WR/TE/RB": {"A", "B"}}


def test_translation_vocabulary(spark):
    raw = ["RB", "QB", "DB", "DL", "K", "LB", "OL", "TE", "WR", "LS", "rb", " RB", "XX", None]
    players = spark.createDataFrame([(str(i), p) for i, p in enumerate(raw)],
                                    "player string, pos1 string")
    norm = dict(P.normalized_positions(players).collect())
    expected = ["RB", "QB", "DEF", "DEF", "K", "DEF", None, "TE", "WR", None, "", "", "", ""]
    for i, e in enumerate(expected):
        assert norm.get(str(i)) == e
    counts = dict(P.position_counts(P.normalized_positions(players)).collect())
    assert counts == {"RB": 1, "QB": 1, "DEF": 3, "K": 1, "TE": 1, "WR": 1, "": 4}


def test_topk_bounds_ties_and_direction(spark):
    rows = [(f"p{i:02d}", pos, float(i % 4)) for i, pos in
            enumerate(["RB", "WR", "TE", "QB", "K", "DEF"] * 6)]
    groups = spark.createDataFrame(rows, "player_id string, position string, mean double")
    groups = groups.select(F.explode(P.slots_of("position")).alias("slot"), "player_id", "mean",
                           F.lit(0.0).alias("variance"))
    best = T.top_players(groups).collect()
    low = T.top_players(groups, best=False).collect()
    for res in (best, low):
        per = {}
        for r in res:
            per.setdefault(r.slot, []).append(r)
        for slot, rs in per.items():
            assert len(rs) == min(TOP_K[slot], groups.filter(F.col("slot") == slot).count())
    # brute force comparison with python sorting
    data = groups.collect()
    for b, res in ((True, best), (False, low)):
        for slot in TOP_K:
            members = [r for r in data if r.slot == slot]
            members.sort(key=lambda r: ((-r.mean if b else r.mean), r.player_id))
            want = [r.player_id for r in members[:TOP_K[slot]]]
            got = [r.player_id for r in sorted((r for r in res if r.slot == slot),
                                               key=lambda r: r.rank)]
            assert got == want


def test_topk_plan_has_partial_group_limit(spark):
    groups = spark.range(1000).select(
        F.element_at(F.array(*[F.lit(s) for s in TOP_K]), (F.col("id") % 7 + 1).cast("int"))
        .alias("slot"), F.col("id").cast("string").alias("player_id"),
        (F.col("id") % 13).cast("double").alias("mean"), F.lit(0.0).alias("variance"))
    plan = T.top_players(groups)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
