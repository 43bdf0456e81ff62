"""Array folds, session splitting and the two scoring paths."""

import pytest
from pyspark.sql import functions as F

from statline.functions.arrays import fold_sums, within
from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.sources.play_views import play_tables

from shared_tables import SF_SMALL

ARR = "a array<struct<yds:int, td:int>>"


def test_fold_null_rules(spark):
    df = spark.createDataFrame(
        [([(10, 1), (None, 2), (5, None)],), ([],), (None,), ([(None, None)],)], ARR)
    got = [tuple(r.s) if r.s is not None else None
           for r in df.select(fold_sums("a", ["yds", "td"]).alias("s")).collect()]
    # like SQL sum: NULLs skipped, no values -> NULL (a NULL array folds to NULL)
    assert got == [(15, 3), (None, None), None, (None, None)]


def test_within_scalar(spark):
    df = spark.createDataFrame([([(30, 1), (24, 0)],), (None,)], ARR)
    got = [r.v for r in df.select(
        within("a", ["yds", "td"], lambda s: F.call_function("div", s["yds"], F.lit(10))
               + F.lit(6) * s["td"]).alias("v")).collect()]
    assert got == [11, None]


def test_formulas_integral_and_fractional(spark):
    df = spark.createDataFrame([(37, 1, 2, 1), (-37, 0, 0, 0)], "y int, i int, t int, c int")
    got = df.select(SC.passing_points(F.col("y"), F.col("i"), F.col("t"), F.col("c")).alias("p"),
                    SC.passing_points(F.col("y"), F.col("i"), F.col("t"), F.col("c"),
                                      integral=False).alias("f"),
                    SC.running_points(F.col("y"), F.col("t"), F.col("c")).alias("r")).collect()
    assert (got[0].p, got[0].r) == (1 - 2 + 2 + 8, 3 + 12 + 2)
    assert got[0].f == pytest.approx(37 / 25 - 2 + 2 + 8)
    assert got[1].p == -1  # truncation toward zero


def _points(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nested_equals_flat(spark):
    t = play_tables(spark, SF_SMALL)
    nested = SC.player_game_points(t)
    flat = SC.player_game_points_flat(t)
    a, b = _points(nested), _points(flat)
    assert len(a) > 1000 and a == b


def test_parts_preserve_everything(spark):
    t = play_tables(spark, SF_SMALL)
    whole = S.scoring_sessions(t, by_game=False, parts=1)
    split = S.scoring_sessions(t, by_game=False, parts=7)
    assert whole.select("player").distinct().count() == whole.count()
    assert {r.part for r in split.select("part").distinct().collect()} == set(range(7))

    def totals(df):
        return sorted(tuple(r) for r in df.groupBy("player").agg(
            *[F.sum(F.when(F.col(k).isNotNull(), F.size(k))).alias(k)
              for k in ("passes", "rushes", "receptions", "fgxp")]).collect())
    assert totals(whole) == totals(split)


def test_one_row_per_player_and_game(spark):
    t = play_tables(spark, SF_SMALL)
    games = S.scoring_sessions(t, by_game=True).filter("gid IS NOT NULL")
    assert games.columns == ["player", "gid", *S.KINDS]
    assert games.count() == games.select("player", "gid").distinct().count() > 1000
    assert S.sessions(t, "passes", by_game=True).columns == ["player", "gid", "passes"]


def test_union_and_join_combinations_agree(spark):
    t = play_tables(spark, SF_SMALL)

    def rows(df, key):
        return sorted(((r.player, str(r[key]),
                        *[sorted(e.pid for e in r[k]) if r[k] is not None else None
                          for k in S.KINDS]) for r in df.collect()), key=str)
    for by_game, key in ((True, "gid"), (False, "part")):
        a = rows(S.scoring_sessions(t, by_game=by_game, method="union"), key)
        b = rows(S.scoring_sessions(t, by_game=by_game, method="join"), key)
        assert len(a) > 1000 and a == b


def test_placeholder_and_null_players_dropped(spark):
    t = play_tables(spark, SF_SMALL)
    players = {r.player for r in SC.player_game_points_flat(t).select("player").collect()}
    assert "XX-0000" not in players and None not in players
    assert t.passes.filter(F.col("psr") == "XX-0000").count() > 0
    assert t.passes.filter(F.col("trg").isNull()).count() > 0


def test_anti_join_removes_fumbles(spark):
    t = play_tables(spark, SF_SMALL)
    rushes = S.rush_plays(t)
    assert rushes.join(t.fumbles, "pid", "left_semi").count() == 0
    assert S.reception_plays(t).join(t.ints, "pid", "left_semi").count() == 0
    # passes keep intercepted plays, flagged
    assert S.pass_plays(t).filter("intcpt = 1").count() > 0


def test_sql_functions(spark):
    from statline.functions.sql import register_sql_functions
    register_sql_functions(spark)
    row = spark.sql("""
        SELECT run_sums(array(named_struct('pid', 'a', 'yds', 37, 'td', 1, 'conv', 0),
                              named_struct('pid', 'b', 'yds', CAST(NULL AS INT), 'td', 0,
                                           'conv', 1))) AS s,
               passing_points(37, 1, 2, 1) AS p, running_points(-37, 0, 0) AS r,
               run_sums(CAST(NULL AS ARRAY<STRUCT<pid: STRING, yds: INT, td: INT, conv: INT>>))
                 AS n""").first()
    assert tuple(row.s) == (37, 1, 1)
    assert row.p == 1 - 2 + 2 + 8 and row.r == -3 and row.n is None
    plan = spark.sql("SELECT passing_points(1, 2, 3, 4) AS x")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Python" not in plan


def test_side_tables_that_repeat_a_play(spark):
    """Left joins fan out, anti joins do not, and kicks take no side table."""
    from statline.sources.warehouse import PlayTables

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    pid = "pid string"
    t = PlayTables(
        passes=df([("a", "Q", "W", 10), ("b", "Q", "W", 20), ("c", "XX-0000", "W", 5), ("d", "Q", None, 7)],
                  "pid string, psr string, trg string, yds int"),
        rushes=df([("e", "R", 3), ("f", "R", 4)], "pid string, bc string, yds int"),
        kicks=df([("g", "K", "FG", 30, "Y"), ("h", "K", "XP", 1, "N")],
                 "pid string, fkicker string, fgxp string, dist int, good string"),
        core=df([(p, 1) for p in "abcdefgh"], "pid string, gid long"),
        scoring=df([("a", 6), ("a", None), ("g", 3), ("g", 3), ("e", 6)], "pid string, pts int"),
        convs=df([("a",), ("e",), ("e",), ("g",)], pid), ints=df([("b",), ("b",), ("e",)], pid),
        fumbles=df([("f",), ("f",), ("a",)], pid), games=df([(1, 2000)], "gid long, seas int"),
        players=df([("Q", "QB")], "player string, pos1 string"))
    got = sorted((r.kind, r.player, r.pid, r.td, r.conv, r.intcpt) for r in S.plays(t).collect())
    none = None
    assert [x for x in got if x[0] == "passes"] == [
        ("passes", "Q", "a", 0, 1, 0), ("passes", "Q", "a", 6, 1, 0),
        ("passes", "Q", "b", 0, 0, 1), ("passes", "Q", "b", 0, 0, 1), ("passes", "Q", "d", 0, 0, 0)]
    assert sorted(x[2:5] for x in got if x[0] == "receptions") == [
        ("a", 0, 1), ("a", 6, 1), ("c", 0, 0)]
    assert [x[2:5] for x in got if x[0] == "rushes"] == [("e", 6, 1), ("e", 6, 1)]
    assert [x for x in got if x[0] == "fgxp"] == [("fgxp", "K", "g", none, none, none)]
    for kind in S.KINDS:  # one kind alone is the same
        alone = S.plays(t, (kind,)).collect()
        assert sorted(map(str, alone)) == sorted(str(r) for r in S.plays(t).collect() if r.kind == kind)
