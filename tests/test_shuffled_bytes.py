"""What the session queries shuffle and store, on rows of their own."""

import glob
import os
import re

import pytest

from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.plans import jobs, registry
from statline.sources.warehouse import PlayTables, save_warehouse

PLAYERS = ("a", "b", "c")


@pytest.fixture()
def t(spark):
    """Plays of three players in four games, some in no game, some of two kinds."""
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    pids = [f"p{i:03d}" for i in range(120)]
    who = {p: PLAYERS[i % 3] for i, p in enumerate(pids)}
    return PlayTables(
        passes=table([(p, who[p], PLAYERS[i % 2], i) for i, p in enumerate(pids[:60])],
                     "pid string, psr string, trg string, yds int"),
        rushes=table([(p, who[p], 1) for p in pids[60:100]], "pid string, bc string, yds int"),
        kicks=table([(p, who[p], "FG", 30, "Y") for p in pids[100:]],
                    "pid string, fkicker string, fgxp string, dist int, good string"),
        core=table([(p, None if i % 5 == 0 else i % 4) for i, p in enumerate(pids)],
                   "pid string, gid long"),
        scoring=table([(p, 6) for p in pids[::7]], "pid string, pts int"),
        convs=table([(p,) for p in pids[::11]], "pid string"),
        ints=table([(p,) for p in pids[:60:13]], "pid string"),
        fumbles=table([(p,) for p in pids[60:100:9]], "pid string"),
        games=table([(g, 2000) for g in range(4)], "gid long, seas int"),
        players=table([(p, "QB") for p in PLAYERS], "player string, pos1 string"))


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def codecs(folder):
    import pyarrow.parquet as pq

    found = set()
    for f in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        found |= {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups)
                  for c in range(meta.num_columns)}
    return found


def test_f1_play_job_shuffles_no_game_twice(spark, t, out_dir):
    """Points of the stored sessions: rows with a game id are not shuffled."""
    points = jobs.play_job(t, out_dir, play_buckets=3)
    sessions = spark.read.parquet(os.path.join(out_dir, "sessions_all_by_game"))
    found = SC.score_sessions(sessions, one_row_a_game=True)
    grouped = plan(found).split("Union", 1)[1]
    assert len(re.findall(r"Exchange hashpartitioning", grouped)) == 1
    assert "isnull(gid" in grouped
    assert rows(found) == rows(points) == rows(SC.score_sessions(sessions)) == rows(
        SC.player_game_points_flat(t))
    for name in ("plays_in_3", *jobs.SESSION_TABLES, "game_points"):
        assert codecs(os.path.join(out_dir, name)) == {"ZSTD"}


def test_f1_repeated_games_of_a_reused_table_add_up(spark, t, out_dir):
    """A table that was there before the job may repeat a game."""
    one = S.scoring_sessions(t, by_game=True)
    one.unionByName(one).write.parquet(os.path.join(out_dir, "sessions_all_by_game"))
    points = jobs.play_job(t, out_dir, reuse=True, play_buckets=3)
    assert points.count() == one.select("player", "gid").distinct().count()


def test_f2_warehouse_tables_are_stored_small(spark, t, out_dir):
    save_warehouse(t, "small_warehouse", out_dir)
    assert codecs(out_dir) == {"ZSTD"}
    assert rows(spark.table("small_warehouse.core")) == rows(t.core)


def test_f3_full_joins_shuffle_their_halves_once(spark, t, no_broadcast):
    joined = S.scoring_sessions(t, by_game=True, method="join")
    found = plan(joined)
    assert len(re.findall(r"FullOuter", found)) == 3
    coalesced = [line for line in found.splitlines()
                 if "Exchange hashpartitioning(coalesce" in line
                 or re.search(r"Exchange hashpartitioning\(player#\d+, part#\d+, gid#\d+L?, \d+\), ENSURE", line)]
    assert len(coalesced) == 2
    assert rows(joined) == rows(S.scoring_sessions(t, by_game=True))


def test_f4_points_of_the_batches_are_built_once(spark, t, monkeypatch):
    built = []
    monkeypatch.setattr(registry, "play_tables", lambda *_: t)
    monkeypatch.setattr(registry.SM, "add", lambda points, *a, f=registry.SM.add: (
        built.append(plan(points)), f(points, *a)))
    found = registry.merged_season_stats(spark, "")
    assert len(built) == 3
    assert not any("Join" in p or "Exchange" in p for p in built)
    assert rows(found) == rows(registry.season_stats(spark, ""))


def test_f5_plays_are_shuffled_as_rows_and_once(spark, t, no_broadcast):
    """Arrays are gathered behind the shuffle; the report shuffles only the
    rows without a game."""
    report = registry.session_report(S.scoring_sessions(t, by_game=True), True)
    exchanges = [line for line in plan(report).splitlines() if "Exchange hashpartitioning" in line]
    assert "REPARTITION_BY_COL" in exchanges[0] and "part#" in exchanges[0]
    assert sum("REPARTITION_BY_COL" in line for line in exchanges) == 2  # with a game id, without
    found = report.collect()
    keys = [(r.player, r.gid) for r in found]
    assert len(keys) == len(set(keys)) and ("a", None) in keys
    assert sum(r.n_passes or 0 for r in found) == 60
    assert sum(r.n_rushes or 0 for r in found) == 40 - len(range(60, 100, 9))
