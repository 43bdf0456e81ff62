"""Season statistics: the reference's first unit test, plus NULL defaults."""

from pyspark.sql import functions as F

from statline.operators import stats as ST

POINTS = "player string, gid int, passing int, rushing int, receiving int"


def _stats(spark, points, games):
    pts = spark.createDataFrame(points, POINTS)
    g = spark.createDataFrame(games, "gid int, seas int")
    return {(r.player_id, r.season): r for r in ST.season_stats(pts, g).collect()}


def test_reference_fixture(spark):
    got = _stats(spark, [("foo", 1, 0, 1, 1), ("foo", 1, 0, 1, 3), ("bar", 2, 0, 2, 1)],
                 [(1, 2001), (2, 2002)])
    assert set(got) == {("foo", 2001), ("bar", 2002)}
    foo = got[("foo", 2001)]
    assert foo.games == 2
    assert (foo.passing_mean, foo.passing_variance) == (0.0, 0.0)
    assert (foo.rushing_mean, foo.rushing_variance) == (1.0, 0.0)
    assert (foo.receiving_mean, foo.receiving_variance) == (2.0, 2.0)
    assert (foo.total_mean, foo.total_variance) == (3.0, 2.0)
    bar = got[("bar", 2002)]
    assert bar.games == 1
    assert (bar.passing_mean, bar.rushing_mean, bar.receiving_mean) == (0.0, 2.0, 1.0)
    assert (bar.total_mean, bar.total_variance) == (3.0, 0.0)


def test_null_defaults(spark):
    # NULL points count as 0 (the game still counts); NULL gid is game 0;
    # NULL games rows become (-9, -9) and never match a points gid of 0.
    got = _stats(spark, [("a", 5, None, 4, None), ("a", 5, 2, None, None),
                         ("b", None, 1, 1, 1)],
                 [(5, 2010), (None, None), (0, 1999)])
    a = got[("a", 2010)]
    assert a.games == 2 and a.passing_mean == 1.0 and a.rushing_mean == 2.0
    assert a.rushing_variance == 8.0
    assert ("b", 1999) in got and got[("b", 1999)].games == 1
    assert all(season != -9 for _, season in got)


def test_variance_matches_var_samp(spark):
    rows = [("p", g % 7, g, (g * 3) % 11, (g * g) % 13) for g in range(60)]
    pts = spark.createDataFrame(rows, POINTS)
    games = spark.createDataFrame([(g, 2000 + g % 2) for g in range(7)], "gid int, seas int")
    ours = ST.season_stats(pts, games)
    ref = (pts.join(games, "gid").groupBy(F.col("player").alias("player_id"),
                                          F.col("seas").alias("season"))
           .agg(F.coalesce(F.var_samp("rushing"), F.lit(0.0)).alias("v"),
                F.avg("rushing").alias("m")))
    joined = ours.join(ref, ["player_id", "season"]).collect()
    assert len(joined) == 2
    for r in joined:
        assert abs(r.rushing_variance - r.v) < 1e-9 and abs(r.rushing_mean - r.m) < 1e-12


def test_yearly_nesting_and_target_filter(spark):
    stats = spark.createDataFrame(
        [("x", 2000, 3, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 3.0, 0.0),
         ("x", 1999, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
         ("y", 2000, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
         ("z", 2000, 2, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0),
         ("w", 1999, 2, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0)],
        "player_id string, season int, games long, passing_mean double, "
        "passing_variance double, rushing_mean double, rushing_variance double, "
        "receiving_mean double, receiving_variance double, total_mean double, "
        "total_variance double")
    yearly = ST.player_yearly_stats(stats)
    x = yearly.filter("playerId = 'x'").first()
    assert [e.year for e in x.statsByYear] == [1999, 2000]
    kept = {r.playerId for r in ST.scored_in(yearly, 2000).collect()}
    assert kept == {"x", "z"}  # y has mean 0, w has no 2000 entry; negative means pass
    flat = ST.flatten_yearly(ST.scored_in(yearly, 2000)).filter("player_id = 'x'")
    assert flat.count() == 2
    m = yearly.select("playerId", ST.stats_by_year_map().alias("m")).select(
        "playerId", F.map_contains_key("m", 2000).alias("has"),
        F.try_element_at("m", F.lit(2000))["totalStats"]["mean"].alias("mean"))
    got = {r.playerId: (r.has, r.mean) for r in m.collect()}
    assert got["x"] == (True, 3.0) and got["w"] == (False, None)
