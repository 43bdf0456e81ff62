"""Plan properties of every registered query (regression guard)."""

import re

import pytest

from statline.plans.registry import queries

from shared_tables import SF_SMALL

# Queries that write and read back in between show only the last part of their work.
WRITERS = ("schedule_csv", "schedule_rejects", "schedule_accepted", "merged_season_stats",
           "named_table_jobs", "resumed_prediction_job", "roster_job_output")
NAMES = sorted(n for n in queries() if not n.startswith("sink_") and n not in WRITERS)


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_jvm_only_and_pruned(spark, name):
    plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan           # no Python UDF / pandas UDF anywhere
    assert "CartesianProduct" not in plan
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plan)
    for cols in scans:
        # every lineitem scan reads only the columns it needs (the table has 11)
        assert len(cols.split(",")) < 11, cols


def _plan(spark, df):
    """The plan without broadcasts and before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plays_are_enriched_once(spark, no_broadcast):
    plan = _plan(spark, queries()["player_game_points_flat"](spark, SF_SMALL))
    assert 1 <= plan.count("SortMergeJoin") <= 5


@pytest.mark.parametrize("name", ["top_by_position", "position_groups", "rosters"])
def test_target_year_is_taken_before_the_joins(spark, no_broadcast, name):
    plan = _plan(spark, queries()[name](spark, SF_SMALL))
    assert "statsByYear" not in plan
    if name != "rosters":  # rosters gather at most 31 rows
        assert "collect_list" not in plan
    orders = [line for line in plan.splitlines() if "orders.parquet" in line]
    assert orders
    season = next(i for i, line in enumerate(plan.splitlines()) if "Filter" in line and "2000" in line)
    scan = plan.splitlines().index(orders[0])
    between = plan.splitlines()[season:scan]
    assert season < scan and not any("Join" in line for line in between)


def test_other_seasons_are_filtered_before_the_shuffle(spark, no_broadcast):
    """Points meet a Bloom filter of the year's games below their exchanges."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        df = queries()["position_groups"](spark, SF_SMALL)
        lines = _plan(spark, df).splitlines()
        got = sorted(map(str, df.collect()))
    finally:
        spark.conf.set(key, before)
    at = next(i for i, line in enumerate(lines) if "might_contain" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    # Spark pushes the test down as far as the scan of the plays' games
    above, level = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < level:
            above, level = [*above, lines[i]], depth[i]
    assert any("Exchange hashpartitioning(" in line for line in above)
    assert any("Join [gid" in line for line in above)
    assert got == sorted(map(str, queries()["position_groups"](spark, SF_SMALL).collect()))


@pytest.mark.parametrize("name", ["html_table_rows_pages"])
def test_tables_are_read_inside_a_page(spark, name):
    assert "Exchange" not in _plan(spark, queries()[name](spark, SF_SMALL))


def test_building_a_query_runs_nothing(spark):
    """Session, top-k and roster queries are plans until they are asked for."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "no jobs expected")
    try:
        from statline.operators import rosters, scoring, sessions
        from statline.plans.registry import top
        from statline.sources.play_views import play_tables

        t = play_tables(spark, SF_SMALL)  # schema inference runs its own small jobs
        before = set(tracker.getJobIdsForGroup("build-only"))
        sessions.scoring_sessions(t, by_game=False)
        scoring.player_game_points(t)
        rosters.rosters(top(t, True))
        assert set(tracker.getJobIdsForGroup("build-only")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
