"""The input tables: loading them from a warehouse, and typed scans of the
three inputs of the season job with NULL defaults.

Columns are bound by name, not by position.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.sources.sinks import CODEC

# ---------------------------------------------------------------------------
# The warehouse's table names and the columns that are read.
WAREHOUSE_TABLES = {
    "passes": ("pass", ("pid", "psr", "trg", "yds")),
    "rushes": ("rush", ("pid", "bc", "yds")),
    "kicks": ("fgxp", ("pid", "fkicker", "fgxp", "dist", "good")),
    "core": ("core", ("pid", "gid")),
    "scoring": ("scoring_14", ("pid", "pts")),
    "convs": ("convs", ("pid",)),
    "ints": ("ints", ("pid",)),
    "fumbles": ("fumbles", ("pid",)),
    "games": ("games", ("gid", "seas")),
    "players": ("players", ("player", "pos1")),
}
# ---------------------------------------------------------------------------

POINT_COLUMNS = ("passing", "rushing", "receiving")


@dataclass(frozen=True)
class PlayTables:
    """The ten input tables of the reference, as DataFrames."""

    passes: DataFrame     # pid, psr, trg, yds
    rushes: DataFrame     # pid, bc, yds
    kicks: DataFrame      # pid, fkicker, fgxp, dist, good
    core: DataFrame       # pid, gid
    scoring: DataFrame    # pid, pts
    convs: DataFrame      # pid
    ints: DataFrame       # pid
    fumbles: DataFrame    # pid
    games: DataFrame      # gid, seas
    players: DataFrame    # player, pos1


def warehouse_tables(spark: SparkSession, database: str) -> PlayTables:
    """The ten input tables of a database, only the columns that are read."""
    return PlayTables(**{f.name: spark.table(f"{database}.{WAREHOUSE_TABLES[f.name][0]}").select(
        *WAREHOUSE_TABLES[f.name][1]) for f in fields(PlayTables)})


def stored_points(spark: SparkSession, table: str) -> DataFrame:
    """A table of game points (player, gid, passing, rushing, receiving)."""
    return spark.table(table).select("player", "gid", *POINT_COLUMNS)


def save_warehouse(t: PlayTables, database: str, location: str) -> None:
    """Writes the tables as external tables of a database under ``location``."""
    spark = t.core.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, (table, _) in WAREHOUSE_TABLES.items():
        (getattr(t, name).write.mode("errorifexists").option("path", f"{location}/{table}")
         .option("compression", CODEC).saveAsTable(f"{database}.{table}"))


def player_game_records(points: DataFrame) -> DataFrame:
    """``player_game_points`` -> (player_id, gid, passing, rushing, receiving).

    The player id keeps NULL; game id and points default to 0, so a game with
    NULL points still counts as a game.
    """
    return points.select(
        F.col("player").alias("player_id"),
        F.coalesce(F.col("gid").cast("bigint"), F.lit(0).cast("bigint")).alias("gid"),
        *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in POINT_COLUMNS],
    )


def game_seasons(games: DataFrame) -> DataFrame:
    """``games`` -> (gid, season); NULLs become -9 (never equal to a points gid of 0)."""
    return games.select(
        F.coalesce(F.col("gid").cast("bigint"), F.lit(-9).cast("bigint")).alias("gid"),
        F.coalesce(F.col("seas").cast("int"), F.lit(-9)).alias("season"),
    )


def player_positions(players: DataFrame) -> DataFrame:
    """``players`` -> (player_id, raw_position); NULLs become ""."""
    return players.select(
        F.coalesce(F.col("player"), F.lit("")).alias("player_id"),
        F.coalesce(F.col("pos1"), F.lit("")).alias("raw_position"),
    )
