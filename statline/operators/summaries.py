"""Season summaries that are stored and merged.

The stored state of a player's season is its moments: games, sums and sums of
squares, as exact integers.  A batch of new games adds rows of moments beside
those of earlier batches; reading adds them up, so means and variances are the
same, bit for bit, as from all points at once, in whatever batches they came.

A batch has a name and is stored once: a batch that is there already is an
error, so a job that is started twice does not count its games twice.  A folder
holds one moments row per player, season and batch; ``compact`` turns the
batches into one.

    summaries.add(points_of_week_1, games, folder, "2014-01")
    summaries.add(points_of_week_2, games, folder, "2014-02")
    season = summaries.season_stats(spark, folder)

A game belongs to one batch; games whose points are split over batches count
once in each, as rows of points always count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.operators import stats as ST
from statline.sources import sinks as K


def _path(folder: str, batch: str) -> str:
    if not batch or "/" in batch or "=" in batch:
        raise ValueError(f"{batch!r} cannot name a batch")
    return f"{folder.rstrip('/')}/batch={batch}"


def add(points: DataFrame, games: DataFrame, folder: str, batch: str) -> None:
    """Stores the moments of a batch of points."""
    K.create_table_as(ST.season_moments(points, games), _path(folder, batch))


def merged(moments: DataFrame) -> DataFrame:
    """Moments of the same player and season added up."""
    return moments.groupBy("player_id", "season").agg(
        *[F.sum(c).alias(c) for c in ST.MOMENT_COLUMNS])


def moments(spark: SparkSession, folder: str) -> DataFrame:
    """The moments of all batches of a folder."""
    return merged(spark.read.parquet(folder))


def season_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The season statistics of all batches."""
    return ST.stats_of(moments(spark, folder))


def compact(spark: SparkSession, folder: str, into: str, batch: str = "all") -> None:
    """The merged moments as the only batch of a new folder."""
    K.create_table_as(moments(spark, folder), _path(into, batch))
