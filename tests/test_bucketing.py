"""Bucketed play tables: same results, and the pid joins need no shuffle."""

from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.plans.bucketing import bucket_play_tables
from statline.sources.play_views import play_tables

from shared_tables import SF_SMALL


def test_bucketed_tables_join_without_exchange(spark):
    t = play_tables(spark, SF_SMALL)
    b = bucket_play_tables(spark, t, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force sort-merge joins
    try:
        plan = S.rush_plays(b)._jdf.queryExecution().executedPlan().toString()
        plain = S.rush_plays(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" in plain
    got = sorted((tuple(r) for r in SC.player_game_points_flat(b).collect()), key=str)
    assert got == sorted((tuple(r) for r in SC.player_game_points_flat(t).collect()), key=str)
