"""Roster positions: normalisation, counts and the seven position groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.functions.positions import draftworthy, roster_position, slots_of
from statline.operators.stats import year_mean, year_variance
from statline.sources.warehouse import player_positions


def normalized_positions(players: DataFrame) -> DataFrame:
    """(player_id, position): raw positions translated, OFF and LS dropped."""
    return (player_positions(players)
            .select("player_id", roster_position("raw_position").alias("position"))
            .filter(draftworthy("position")))


def position_counts(positions: DataFrame) -> DataFrame:
    """(position, players); the unknown position "" is a group of its own."""
    return positions.groupBy("position").agg(F.count(F.lit(1)).alias("players"))


def position_groups(yearly: DataFrame, positions: DataFrame, year: int) -> DataFrame:
    """Players with stats joined to their position, one row per group they
    belong to: (slot, player_id, statsByYear, mean, variance).

    RB, QB, TE, K, DEF and WR are their own groups; WR, TE and RB players are
    also in the flex group ``WR/TE/RB`` (a UNION ALL, done as one explode).
    """
    joined = positions.join(yearly.withColumnRenamed("playerId", "player_id"), "player_id")
    return joined.select(
        F.explode(slots_of("position")).alias("slot"), "player_id", "statsByYear",
        year_mean(year).alias("mean"), year_variance(year).alias("variance"))


def scorer_groups(scorers: DataFrame, positions: DataFrame) -> DataFrame:
    """(slot, player_id, mean, variance): :func:`position_groups` for consumers
    of one season (see ``stats.year_scorers``); only two doubles travel."""
    return positions.join(scorers, "player_id").select(
        F.explode(slots_of("position")).alias("slot"), "player_id", "mean", "variance")


def group(groups: DataFrame, slot: str) -> DataFrame:
    """One position group."""
    return groups.filter(F.col("slot") == slot)
