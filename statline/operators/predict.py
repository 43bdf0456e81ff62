"""Season prediction table and its per-position extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positions exported one file each.
EXTRACT_POSITIONS = ("WR", "RB", "QB", "TE")

NULL_GAME_SALTS = 64

_WIDE = "decimal(38,0)"


def player_prediction(points: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """(player, seas, totalPts, stddev, pos1) per player, raw position and season.

    points ⟕ games on gid ⟕ players on player (unmatched rows keep NULL
    season/position and form their own groups).  totalPts is the sum of
    passing+rushing+receiving (NULL as 0); stddev is the population standard
    deviation of that per-game sum, from exact integer moments.
    """
    x = (F.coalesce(F.col("passing"), F.lit(0)) + F.coalesce(F.col("rushing"), F.lit(0))
         + F.coalesce(F.col("receiving"), F.lit(0))).cast("bigint")
    # Moments per (player, season) first (partial aggregation, so a hot
    # player is a few rows per map task), then the position join on the
    # small result.  Joining first would let a shuffle join on player hand
    # its partitioning to the grouping and gather a hot player in one task.
    # Moments are additive, so a player listed twice in ``players`` still
    # counts every game twice, exactly as joining before grouping does.
    # Points without a game id match no game; the salt spreads them over
    # partitions, where the bare NULL key would gather them in one.
    salt = F.when(F.col("gid").isNull(), F.pmod(F.xxhash64("player"), F.lit(NULL_GAME_SALTS)))
    base = points.select("player", "gid", x.alias("x")).withColumn(
        "_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    per_season = (base.join(games.select("gid", "seas", F.lit(0).alias("_salt")),
                            ["gid", "_salt"], "left")
                  .groupBy("player", "seas")
                  .agg(F.count(F.lit(1)).alias("_n"), F.sum("x").alias("_s"),
                       F.sum(F.col("x") * F.col("x")).alias("_ss")))
    g = (per_season.join(players.select("player", "pos1"), "player", "left")
         .groupBy("player", "pos1", "seas")
         .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("totalPts"),
              F.sum("_ss").alias("_ss")))
    n, s, ss = (F.col(c).cast(_WIDE) for c in ("_n", "totalPts", "_ss"))
    var_pop = (n * ss - s * s).cast("double") / (n * n).cast("double")
    return g.select("player", "seas", "totalPts", F.sqrt(var_pop).alias("stddev"), "pos1")


def prediction_extract(prediction: DataFrame, players: DataFrame,
                       positions: Sequence[str] = EXTRACT_POSITIONS) -> DataFrame:
    """(player, seas, totalPts, stddev, pos1) of the exported positions, each
    row joined to ``players`` (a player listed twice appears twice)."""
    pred = prediction.filter(F.col("pos1").isin(*positions))
    return (players.select("player").join(pred, "player", "inner")
            .select("player", "seas", "totalPts", "stddev", "pos1"))
