"""Whole-or-absent tables, named tables, resumed jobs, one pass over the plays."""

import glob
import os
import re
import uuid

import pytest

from statline.operators import predict as PR
from statline.operators import sessions as S
from statline.plans import jobs
from statline.plans.bucketing import read_enriched_plays, write_enriched_plays
from statline.plans.store import TABLE_NAMES, ChangedInputs, Store, fingerprint
from statline.sources import sinks as K
from statline.sources.play_views import TARGET_YEAR, play_tables

from shared_tables import SF_SMALL


def half_written(path):
    os.makedirs(os.path.join(path, "_temporary", "0"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_half_written_folder_is_no_table(spark, out_dir):
    path = os.path.join(out_dir, "t")
    assert K.table_state(spark, path) == K.ABSENT
    half_written(path)
    assert K.table_state(spark, path) == K.PARTIAL
    for if_not_exists in (True, False):
        with pytest.raises(K.IncompleteTable):
            K.create_table_as(spark.range(3), path, if_not_exists=if_not_exists)
    K.create_table_as(spark.range(3), path, mode="overwrite")
    assert K.table_state(spark, path) == K.WHOLE and spark.read.parquet(path).count() == 3
    K.create_table_as(spark.range(9), path, if_not_exists=True)
    assert spark.read.parquet(path).count() == 3


def test_named_tables(spark, out_dir):
    db = f"t_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    name, path = f"{db}.numbers", os.path.join(out_dir, "numbers")
    half_written(path)
    with pytest.raises(K.IncompleteTable):
        K.create_named_table(spark.range(3), name, path, if_not_exists=True)
    K.create_named_table(spark.range(3), name, path, mode="overwrite")
    K.create_named_table(spark.range(5), name, path, if_not_exists=True)
    assert spark.table(name).count() == 3
    with pytest.raises(Exception, match="already exists"):
        K.create_named_table(spark.range(5), name, path)
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(FileExistsError):  # whole, but not that table
        K.create_named_table(spark.range(5), name, path)


def test_jobs_by_table_names(spark, out_dir):
    db = f"t_{uuid.uuid4().hex[:8]}"
    t = play_tables(spark, SF_SMALL)
    store = Store(spark, out_dir, database=db)
    points = jobs.play_job(t, store, play_buckets=3)
    names = {r.tableName for r in spark.sql(f"SHOW TABLES IN {db}").collect()}
    assert names == set(TABLE_NAMES.values()) - {"player_prediction"}
    assert rows(points) == rows(spark.table(f"{db}.player_game_points"))
    jobs.prediction_job(points, t.games, t.players, store)
    assert rows(spark.table(f"{db}.player_prediction")) == rows(
        PR.player_prediction(points, t.games, t.players))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_pass_over_the_plays(spark, out_dir):
    """Five joins in all; the ten nestings read the stored plays without a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = play_tables(spark, SF_SMALL)
        assert len(re.findall(r"SortMergeJoin", plan(S.enriched(t)))) == 5
        path = os.path.join(out_dir, "plays")
        write_enriched_plays(S.enriched(t), path, 4)
        assert len(glob.glob(f"{path}/*.parquet")) == 4
        plays = read_enriched_plays(spark, path, 4)
        assert rows(plays) == rows(S.enriched(t))
        for kind, by_game in jobs.SESSION_TABLES.values():
            nested = jobs._sessions(plays, kind, by_game)
            found = plan(nested)
            assert "Exchange" not in found and "Join" not in found
            want = S.scoring_sessions(t, by_game) if kind == "all" else S.sessions(t, kind, by_game)
            assert rows(nested) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_arrays_do_not_depend_on_partitions(spark):
    t = play_tables(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(S.combine(S.enriched(t).repartition(int(n) + 2), by_game=True)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def stored_inputs(spark, folder):
    t = play_tables(spark, SF_SMALL)
    path = os.path.join(folder, "points")
    spark.createDataFrame([("1", 1, 5, 0, 2), ("2", 1, 0, 7, 0), ("1", 2, 1, 1, 1)],
                          "player string, gid long, passing int, rushing int, receiving int").write.parquet(path)
    return spark.read.parquet(path), t.games, t.players


def test_a_killed_job_goes_on(spark, out_dir, monkeypatch):
    points, games, players = stored_inputs(spark, out_dir)
    folder = os.path.join(out_dir, "jobs")
    inputs = [points, games, players]
    built = []

    def counted(name, f):
        def run(*args, **kwargs):
            built.append(name)
            return f(*args, **kwargs)
        return run

    monkeypatch.setattr(jobs.PR, "player_prediction", counted("prediction", PR.player_prediction))
    monkeypatch.setattr(jobs.ST, "season_stats", counted("stats", jobs.ST.season_stats))

    def die(*_):
        half_written(os.path.join(folder, "scorers_by_group"))
        raise KeyboardInterrupt

    def start():
        store = Store(spark, folder, resume=fingerprint(inputs, year=TARGET_YEAR))
        jobs.run_points(points, games, players, store, TARGET_YEAR)

    with monkeypatch.context() as m:
        m.setattr(jobs.K, "write_position_groups", die)
        with pytest.raises(KeyboardInterrupt):
            start()
    assert built == ["prediction", "stats"]
    start()  # goes on after the scorers
    assert built == ["prediction", "stats"]
    assert K.table_state(spark, os.path.join(folder, "scorers_by_group")) == K.WHOLE
    assert K.table_state(spark, os.path.join(folder, "rosters")) == K.WHOLE
    with monkeypatch.context() as m:  # nothing is left to write
        m.setattr(jobs.K, "write_rosters", die)
        start()


def test_changed_inputs_are_refused(spark, out_dir):
    points, games, players = stored_inputs(spark, out_dir)
    folder = os.path.join(out_dir, "jobs")
    first = fingerprint([points, games, players], year=1)
    assert first == fingerprint([players, points, games], year=1) != fingerprint([points, games, players], year=2)
    Store(spark, folder, resume=first).create("season_prediction", lambda: spark.range(2))
    spark.createDataFrame([("9", 9, 9, 9, 9)], points.schema).write.mode("append").parquet(
        os.path.join(out_dir, "points"))
    again = spark.read.parquet(os.path.join(out_dir, "points"))
    other = Store(spark, folder, resume=fingerprint([again, games, players], year=1))
    with pytest.raises(ChangedInputs):
        other.create("season_prediction", lambda: spark.range(2))
    with pytest.raises(ValueError):
        fingerprint([spark.range(3)])


def test_a_recorded_step_that_is_gone_is_built_again(spark, out_dir):
    store = Store(spark, out_dir, resume="x")
    store.create("a", lambda: spark.range(2))
    os.remove(os.path.join(out_dir, "a", "_SUCCESS"))
    assert store.create("a", lambda: spark.range(5)).count() == 5


def test_files_follow_the_bytes(spark, out_dir):
    """Folders by value: not one file for each task and value, and a large
    value in several files."""
    from pyspark.sql import functions as F

    df = spark.range(60_000, numPartitions=30).select(
        F.when(F.col("id") % 100 == 0, F.lit("TE")).otherwise(F.lit("WR")).alias("pos1"),
        F.col("id").cast("string").alias("player"), F.lit(1).alias("seas"),
        F.xxhash64("id").alias("totalPts"), F.rand(1).alias("stddev"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)

    def files(advisory, name):
        spark.conf.set(size, advisory)
        K.write_position_extract(df, os.path.join(out_dir, name))
        return {p: len(glob.glob(os.path.join(out_dir, name, f"pos1={p}", "*.csv"))) for p in ("TE", "WR")}

    try:
        whole, cut = files("64MB", "whole"), files("200KB", "cut")
    finally:
        spark.conf.set(size, before)
    assert whole == {"TE": 1, "WR": 1}
    assert cut["TE"] <= 2 and 3 <= cut["WR"] <= 30
    assert K.read_position_extract(spark, os.path.join(out_dir, "cut")).count() == 60_000
