"""Per-player, per-season summary of the game points: games played, mean and
sample variance of passing, rushing and receiving points, and their totals.

Moments are taken from exact integer sums (count, Σx, Σx²): one partial
aggregation, and the result does not depend on how rows are partitioned or
merged.  Sample variance is ``(nΣx² − (Σx)²) / (n(n−1))``, 0 for one game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.functions.arrays import find_first
from statline.sources.warehouse import POINT_COLUMNS, game_seasons, player_game_records

_WIDE = "decimal(38,0)"  # products of sums cannot overflow for any realistic group

GAME_ZERO_SALTS = 64  # join keys of game 0, where all NULL game ids go

# mean and sample variance from n = games, s = Σx, ss = Σx² (exact integers)
_MEAN = "CAST({s} AS DOUBLE) / CAST(games AS DOUBLE)"
_VAR_SAMP = (
    f"CASE WHEN games > 1 THEN "
    f"CAST(CAST(games AS {_WIDE}) * CAST({{ss}} AS {_WIDE}) - CAST({{s}} AS {_WIDE}) * CAST({{s}} AS {_WIDE}) AS DOUBLE)"
    f" / CAST(CAST(games AS {_WIDE}) * (CAST(games AS {_WIDE}) - 1) AS DOUBLE) ELSE 0.0 END")


MOMENT_COLUMNS = ("games", *[f"{p}_{m}" for m in POINT_COLUMNS for p in ("_s", "_ss")])


def season_moments(points: DataFrame, games: DataFrame, year: int | None = None) -> DataFrame:
    """(player_id, season, games, _s_<m>, _ss_<m>): the number of games, sums and
    sums of squares, all exact integers, so moments of disjoint sets of games
    add up (see :mod:`statline.operators.summaries`).

    Points join games on the game id (inner: games without a season row are
    dropped, repeated game rows multiply, as in the reference).  AQE chooses
    a broadcast of ``games`` only when its measured size is under the
    broadcast threshold, a shuffle join otherwise.  With ``year`` only that
    season's games enter the join.

    A NULL game id counts as game 0, which may hold any share of the rows:
    that one key is salted over ``GAME_ZERO_SALTS`` join keys.

    With ``year``, points of other seasons need not travel to the join: where
    it is a shuffle join, Spark tests their game ids against a Bloom filter of
    the year's games before the exchange (from
    ``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``
    bytes of points on, 10 GB unless set).
    """
    seasons = game_seasons(games)
    if year is not None:
        seasons = seasons.filter(F.col("season") == F.lit(year))
    # game 0 once for each salt, by a join with as many rows: unlike an explode,
    # it lets Spark build its runtime filter from the seasons below it
    salts = games.sparkSession.range(GAME_ZERO_SALTS).selectExpr(
        f"id DIV {GAME_ZERO_SALTS} AS _zero", "CAST(id AS INT) AS _salt")
    seasons = (seasons.join(F.broadcast(salts), F.col("gid") == F.col("_zero"), "left")
               .select("gid", "season", F.coalesce("_salt", F.lit(0)).alias("_salt")))
    salt = F.when(F.col("gid") == 0, F.pmod(F.xxhash64("player_id"), F.lit(GAME_ZERO_SALTS)))
    records = player_game_records(points).withColumn(
        "_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    aggs = ["count(1) AS games"]
    for m in POINT_COLUMNS:
        aggs += [f"sum(CAST({m} AS BIGINT)) AS _s_{m}",
                 f"sum(CAST({m} AS BIGINT) * CAST({m} AS BIGINT)) AS _ss_{m}"]
    return (records.join(seasons, ["gid", "_salt"], "inner")
            .groupBy("player_id", "season").agg(*[F.expr(a) for a in aggs]))


def stats_of(moments: DataFrame) -> DataFrame:
    """Means and variances of moments."""
    out = ["player_id", "season", "games"]
    for m in POINT_COLUMNS:
        out += [f"{_MEAN.format(s=f'_s_{m}')} AS {m}_mean",
                f"{_VAR_SAMP.format(s=f'_s_{m}', ss=f'_ss_{m}')} AS {m}_variance"]
    # totals: sum of the three means and of the three variances (no covariance)
    out += [" + ".join(f"{m}_mean" for m in POINT_COLUMNS) + " AS total_mean",
            " + ".join(f"{m}_variance" for m in POINT_COLUMNS) + " AS total_variance"]
    return moments.selectExpr(*out[:3], *out[3:9]).selectExpr("*", *out[9:])


def season_stats(points: DataFrame, games: DataFrame, year: int | None = None) -> DataFrame:
    """(player_id, season, games, <m>_mean, <m>_variance ..., total_mean, total_variance)."""
    return stats_of(season_moments(points, games, year))


def year_scorers(points: DataFrame, games: DataFrame, year: int) -> DataFrame:
    """(player_id, mean, variance) of the players who scored in ``year``: the
    total mean and variance of that season, other seasons never joined."""
    return (season_stats(points, games, year).filter("total_mean <> 0")
            .selectExpr("player_id", "total_mean AS mean", "total_variance AS variance"))


def _summary(prefix: str) -> Column:
    return F.struct(F.col(f"{prefix}_mean").alias("mean"),
                    F.col(f"{prefix}_variance").alias("variance"))


def player_yearly_stats(stats: DataFrame) -> DataFrame:
    """Nest all seasons of a player: (playerId, statsByYear array sorted by year).

    The record layout is the output schema ``PlayerYearlyStats`` (receiving
    before rushing).  An array holds one element per season, so its size is
    bounded by the number of seasons, not by the data volume.
    """
    entry = F.struct(
        F.col("season").alias("year"),
        F.col("games").cast("int").alias("totalGamesPlayed"),
        _summary("passing").alias("passingStats"),
        _summary("receiving").alias("receivingStats"),
        _summary("rushing").alias("rushingStats"),
        _summary("total").alias("totalStats"))
    return (stats.groupBy(F.col("player_id").alias("playerId"))
            .agg(F.sort_array(F.collect_list(entry)).alias("statsByYear")))


def year_entry(year: int) -> Column:
    """The ``statsByYear`` element of one year, or NULL."""
    return find_first("statsByYear", lambda s: s["year"] == F.lit(year))


def stats_by_year_map(col: Column | str = "statsByYear") -> Column:
    """The season array as a ``map<year, stats>`` (for key tests and lookups
    with ``map_contains_key`` / ``element_at``)."""
    arr = F.col(col) if isinstance(col, str) else col
    return F.map_from_entries(F.transform(arr, lambda s: F.struct(s["year"], s)))


def scored_in(yearly: DataFrame, year: int) -> DataFrame:
    """Players (with all their seasons) who played and scored in ``year``:
    games ≠ 0 and total mean ≠ 0 (negative means pass)."""
    return yearly.filter(F.exists(
        "statsByYear",
        lambda s: (s["year"] == F.lit(year)) & (s["totalGamesPlayed"] != 0)
        & (s["totalStats"]["mean"] != 0)))


def year_mean(year: int) -> Column:
    """Ordering value: total mean of ``year``, 0.0 when the year is missing."""
    return F.coalesce(year_entry(year)["totalStats"]["mean"], F.lit(0.0))


def year_variance(year: int) -> Column:
    return F.coalesce(year_entry(year)["totalStats"]["variance"], F.lit(0.0))


def flatten_yearly(yearly: DataFrame) -> DataFrame:
    """Inverse of :func:`player_yearly_stats` to flat season rows."""
    e = F.col("e")
    return yearly.select(F.col("playerId").alias("player_id"),
                         F.explode("statsByYear").alias("e")).select(
        "player_id",
        e["year"].alias("season"),
        e["totalGamesPlayed"].cast("bigint").alias("games"),
        *[e[f"{m}Stats"][part].alias(f"{m}_{'mean' if part == 'mean' else 'variance'}")
          for m in ("passing", "rushing", "receiving", "total") for part in ("mean", "variance")])
