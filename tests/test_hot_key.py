"""One player holding a third of all plays: spread, bounded, and still exact."""

import dataclasses
import re

from pyspark.sql import functions as F

from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.sources.play_views import play_tables

from shared_tables import SF_SMALL


def _with_hot_player(spark):
    t = play_tables(spark, SF_SMALL)
    hot = F.when(F.xxhash64("pid") % 3 == 0, F.lit("HOT"))
    return dataclasses.replace(
        t,
        passes=t.passes.withColumn("psr", F.coalesce(hot, F.col("psr")))
        .withColumn("trg", F.coalesce(hot, F.col("trg"))),
        rushes=t.rushes.withColumn("bc", F.coalesce(hot, F.col("bc"))))


def test_hot_player_sessions_are_spread_and_exact(spark):
    t = _with_hot_player(spark)
    plays = S.pass_plays(t).filter("player = 'HOT'").count()
    assert plays * 4 > S.pass_plays(t).count()  # roughly a third of the passes
    hot = S.scoring_sessions(t, by_game=False).filter("player = 'HOT'")
    assert hot.count() == S.PARTS  # every part is used
    biggest = hot.select(F.max(F.size("passes"))).first()[0]
    assert biggest < 2 * plays / S.PARTS
    assert hot.select(F.sum(F.size("passes"))).first()[0] == plays
    a = sorted((tuple(r) for r in SC.player_game_points(t).collect()), key=str)
    assert a == sorted((tuple(r) for r in SC.player_game_points_flat(t).collect()), key=str)


def test_layout_does_not_depend_on_the_data(spark):
    """Hot or not, a player has the same parts, and the grouping shuffles on
    them; nothing runs while the plan is built."""
    t = _with_hot_player(spark)
    s = S.scoring_sessions(t, by_game=False)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)",
                      s._jdf.queryExecution().executedPlan().toString())
    assert any("part" in k and "player" in k for k in keys), keys
    widest = s.groupBy("player").agg(F.max("part").alias("p"), F.min("part").alias("q"))
    assert widest.agg(F.max("p"), F.min("q")).first()[:] == (S.PARTS - 1, 0)


def test_plays_without_a_game_are_spread(spark):
    t = play_tables(spark, SF_SMALL)
    t = dataclasses.replace(t, core=t.core.withColumn("gid", F.lit(None).cast("bigint")),
                            passes=t.passes.withColumn("psr", F.lit("HOT")))
    s = S.sessions(t, "passes", by_game=True).filter("player = 'HOT'")
    assert s.count() == S.PARTS and s.columns == ["player", "gid", "passes"]
    a = sorted(map(str, SC.player_game_points(t).collect()))
    assert a == sorted(map(str, SC.player_game_points_flat(t).collect()))
