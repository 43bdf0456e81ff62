"""Composite jobs and the driver entry point."""

import os

import pytest
from pyspark.errors import AnalysisException

from statline.plans import jobs
from statline.plans.registry import queries
from statline.sources.play_views import TARGET_YEAR, play_tables
from statline.sources.warehouse import save_warehouse

from shared_tables import SF_SMALL


def test_run_all_writes_every_output(spark, out_dir):
    jobs.run_all(play_tables(spark, SF_SMALL), out_dir, TARGET_YEAR)
    for name in (*jobs.SESSION_TABLES, "game_points", "season_prediction", "scorers", "rosters"):
        assert spark.read.parquet(os.path.join(out_dir, name)).count() > 0
    assert len(jobs.SESSION_TABLES) == 10
    assert spark.read.text(os.path.join(out_dir, "position_counts")).count() > 0
    slots = {r.slot for r in spark.read.json(os.path.join(out_dir, "scorers_by_group"))
             .select("slot").distinct().collect()}
    assert slots == {"RB", "QB", "TE", "K", "DEF", "WR", "WR/TE/RB"}
    pos = {r.pos1 for r in spark.read.option("sep", "\t").csv(
        os.path.join(out_dir, "prediction_by_position")).select("pos1").distinct().collect()}
    assert pos == {"WR", "RB", "QB", "TE"}
    rosters = spark.read.parquet(os.path.join(out_dir, "rosters"))
    assert rosters.count() == queries()["rosters"](spark, SF_SMALL).count()


def test_play_job_reuses_only_when_asked(spark, out_dir):
    t = play_tables(spark, SF_SMALL)
    jobs.K.create_table_as(spark.range(1), os.path.join(out_dir, "sessions_passes"))
    with pytest.raises(AnalysisException):
        jobs.play_job(t, out_dir)
    jobs.play_job(t, out_dir, reuse=True)
    assert spark.read.parquet(os.path.join(out_dir, "sessions_passes")).columns == ["id"]


def test_run_all_bucketed(spark, out_dir):
    before = spark.catalog.listTables()
    jobs.run_all(play_tables(spark, SF_SMALL), out_dir, TARGET_YEAR, buckets=4)
    a = spark.read.parquet(os.path.join(out_dir, "game_points"))
    assert a.count() == queries()["player_game_points_flat"](spark, SF_SMALL).count()
    assert len(spark.catalog.listTables()) == len(before)  # no names left behind


def test_entry_points(spark, out_dir):
    """From a warehouse database, and from stored points."""
    t = play_tables(spark, SF_SMALL)
    save_warehouse(t, "statline_entry", os.path.join(out_dir, "db"))
    jobs.main(spark, ["warehouse", "statline_entry", os.path.join(out_dir, "a"), "2000"])
    spark.read.parquet(os.path.join(out_dir, "a", "game_points")).write.option(
        "path", os.path.join(out_dir, "pts")).saveAsTable("statline_entry.stored")
    jobs.main(spark, ["points", "statline_entry.stored", "statline_entry.games",
                      "statline_entry.players", os.path.join(out_dir, "b"), "2000"])
    a, b = (spark.read.parquet(os.path.join(out_dir, x, "rosters")) for x in "ab")
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_injury_job(spark, out_dir):
    from statline.plans.fixtures import render_supplier_pages
    d = SF_SMALL
    pages = render_supplier_pages(spark.read.parquet(f"{d}/supplier.parquet"),
                                  spark.read.parquet(f"{d}/nation.parquet"),
                                  spark.read.parquet(f"{d}/region.parquet"))
    jobs.injury_job(pages, out_dir)
    rows = spark.read.csv(os.path.join(out_dir, "injuries")).collect()
    assert len(rows) == queries()["html_table_rows"](spark, d).count() and len(rows[0]) == 7


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["qb", "rb1", "rb2", "wr1", "wr2", "te", "k", "flex", "def",
                          "meanTotal", "varianceTotal"]
    assert df.count() > 0
