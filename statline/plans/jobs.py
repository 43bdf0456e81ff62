"""The reference's four jobs as Spark jobs that write their outputs.

Each job materialises what a later step reads again as a Parquet table in the
output folder and continues from that table, which cuts the lineage: a lost
executor then recomputes from the last written table, not from the plays.

    play job        plays -> ten session tables -> game points            (C3)
    prediction job  game points -> prediction -> extract                  (C4)
    stats job       points -> season stats -> scorers, groups, counts     (C1)
    roster job      scorers -> top players -> every roster                (C2)
    injury job      pages -> rows of HTML data tables -> CSV             (S6 S7)

A job takes a folder, or a :class:`~statline.plans.store.Store`: with a
database its tables have names that later jobs read, and with ``resume`` a job
that died goes on after its last whole step.

Run the four on a warehouse database, on stored points, or on the shared tables:

    python -m statline.plans.jobs warehouse <database> <out_dir> <year> [options]
    python -m statline.plans.jobs points <table> <games> <players> <out_dir> <year> [options]
    python -m statline.plans.jobs shared <data_dir> <out_dir> <year> [options]

Options: --buckets N (play tables bucketed by play id first), --into DATABASE,
--resume.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from statline.operators import positions as P
from statline.operators import predict as PR
from statline.operators import rosters as R
from statline.operators import scoring as SC
from statline.operators import sessions as S
from statline.operators import stats as ST
from statline.operators import topk as T
from statline.plans.store import Store, fingerprint
from statline.sources import sinks as K
from statline.sources.warehouse import PlayTables, stored_points, warehouse_tables

SESSION_TABLES = {f"sessions_{kind}{suffix}": (kind, by_game)
                  for kind in (*S.KINDS, "all")
                  for suffix, by_game in (("", False), ("_by_game", True))}


def _store(spark: SparkSession, out: str | Store, reuse: bool = False) -> Store:
    return out if isinstance(out, Store) else Store(spark, out, reuse=reuse)


def _sessions(plays: DataFrame, kind: str, by_game: bool) -> DataFrame:
    return S.combine(plays, by_game) if kind == "all" else S.nest(plays, kind, by_game)


def play_job(t: PlayTables, out: str | Store, reuse: bool = False,
             play_buckets: int | None = None) -> DataFrame:
    """The ten session tables and the game points.

    The plays are joined with their side tables once and stored in buckets of
    (player, part); every session table is a grouping of that table without a
    shuffle.  ``play_buckets`` is their number (default: the session's shuffle
    partitions).

    A folder that exists is an error; ``reuse=True`` takes an existing table
    as it is (CREATE TABLE IF NOT EXISTS), which is right only while the plays
    have not changed.
    """
    spark = t.core.sparkSession
    store = _store(spark, out, reuse)
    buckets = play_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plays = store.plays(lambda: S.enriched(t), buckets)
    for name, (kind, by_game) in SESSION_TABLES.items():
        store.create(name, lambda kind=kind, by_game=by_game: _sessions(plays, kind, by_game))
    # the points table is new in any case, as its script has it
    points = Store(spark, store.root, store.database, resume=store.resume)
    # (a table that was there already may repeat a game)
    return points.create("game_points", lambda: SC.score_sessions(
        store.table("sessions_all_by_game"), one_row_a_game=not store.reuse))


def prediction_job(points: DataFrame, games: DataFrame, players: DataFrame,
                   out: str | Store) -> None:
    store = _store(points.sparkSession, out)
    prediction = store.create("season_prediction", lambda: PR.player_prediction(points, games, players))
    store.write("prediction_by_position", lambda path, mode: K.write_position_extract(
        PR.prediction_extract(prediction, players), path, mode))


def stats_job(points: DataFrame, games: DataFrame, players: DataFrame, out: str | Store,
              year: int) -> DataFrame:
    """Scorers (nested Parquet), one JSON dataset per position group, counts."""
    store = _store(points.sparkSession, out)
    positions = P.normalized_positions(players)
    store.write("scorers", lambda path, mode: K.write_player_yearly_stats(
        ST.scored_in(ST.player_yearly_stats(ST.season_stats(points, games)), year), path, mode))
    scorers = store.table("scorers")
    store.write("scorers_by_group", lambda path, mode: K.write_position_groups(
        P.position_groups(scorers, positions, year), path, mode))
    store.write("position_counts", lambda path, mode: K.write_key_counts(
        P.position_counts(positions), "position", "players", path, mode))
    return scorers


def roster_job(scorers: DataFrame, players: DataFrame, out: str | Store, year: int,
               best: bool = True, strict: bool = True) -> None:
    """Rosters from the stored scorers: the year's mean and variance are taken
    out of each player's seasons before the position join."""
    season = scorers.select("playerId", ST.year_mean(year).alias("mean"),
                            ST.year_variance(year).alias("variance"))
    groups = P.scorer_groups(season.withColumnRenamed("playerId", "player_id"),
                             P.normalized_positions(players))
    _store(scorers.sparkSession, out).write("rosters", lambda path, mode: K.write_rosters(
        R.rosters(T.top_players(groups, best=best), strict=strict), path, mode))


def injury_job(pages: DataFrame, out: str | Store, html_col: str = "html") -> None:
    """Rows of every table of class ``data`` in a table of pages, written as
    CSV (six cells and the team) -- the scraper's work without the fetch."""
    from statline.sources.html_tables import CELL_COLUMNS, table_rows

    _store(pages.sparkSession, out).write("injuries", lambda path, mode: K.write_csv(
        table_rows(pages, html_col).select(*CELL_COLUMNS, "team"), path, mode))


def run_points(points: DataFrame, games: DataFrame, players: DataFrame, out: str | Store,
               year: int) -> None:
    """The jobs that start from stored points."""
    prediction_job(points, games, players, out)
    roster_job(stats_job(points, games, players, out, year), players, out, year)


def run_all(t: PlayTables, out: str | Store, year: int, buckets: int | None = None) -> None:
    """All four jobs.  With ``buckets``, the pid-keyed play tables are first
    written bucketed on pid (see :mod:`statline.plans.bucketing`), so the
    play joins of the play job run without shuffles."""
    store = _store(t.core.sparkSession, out)
    source = t
    if buckets:
        from statline.plans.bucketing import bucket_play_tables

        # the bucketed copy serves this run alone
        source = bucket_play_tables(store.spark, t, buckets)
    run_points(play_job(source, store), t.games, t.players, store, year)


def _arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="statline.plans.jobs")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, names in (("warehouse", ["database"]), ("shared", ["data_dir"]),
                        ("points", ["table", "games", "players"])):
        one = kinds.add_parser(kind)
        for name in (*names, "out"):
            one.add_argument(name)
        one.add_argument("year", type=int)
        one.add_argument("--buckets", type=int)
        one.add_argument("--into")
        one.add_argument("--resume", action="store_true")
    return parser.parse_args(args)


def main(spark: SparkSession, args: list[str]) -> None:
    a = _arguments(args)
    if a.kind == "points":
        inputs = [stored_points(spark, a.table), spark.table(a.games), spark.table(a.players)]
    else:
        if a.kind == "warehouse":
            t = warehouse_tables(spark, a.database)
        else:
            from statline.sources.play_views import play_tables

            t = play_tables(spark, a.data_dir)
        inputs = [getattr(t, f.name) for f in fields(t)]
    resume = fingerprint(inputs, year=a.year) if a.resume else None
    store = Store(spark, a.out, a.into, resume=resume)
    if a.kind == "points":
        run_points(*inputs, store, a.year)
    else:
        run_all(t, store, a.year, a.buckets)


if __name__ == "__main__":
    from statline.session import get_session

    main(get_session(), sys.argv[1:])
