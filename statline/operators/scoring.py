"""Fantasy points of a player in a game, two equivalent ways.

* :func:`score_sessions` folds the nested per-game session arrays in one
  projection (``aggregate``), the counterpart of the reference's in-row
  ``within_table`` queries chained by LATERAL VIEW.
* :func:`player_game_points_flat` aggregates the flat plays directly with a
  partial (map-side) ``groupBy``: no arrays at all.  Same rows, same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.functions.arrays import fold_sums
from statline.operators import sessions as S
from statline.sources.play_views import PlayTables

# ---------------------------------------------------------------------------
# The scoring formulas, applied to the per-game sums.
#   passing   = yds/25 - 2*intcpt + 2*conv + 4*td
#   rushing   = yds/10 + 6*td + 2*conv
#   receiving = yds/10 + 6*td + 2*conv
PASS_YARDS_PER_POINT = 25
RUSH_YARDS_PER_POINT = 10
# ---------------------------------------------------------------------------

# measure -> (session array, summed fields)
MEASURES = {"passing": ("passes", ("yds", "intcpt", "td", "conv")),
            "rushing": ("rushes", ("yds", "td", "conv")),
            "receiving": ("receptions", ("yds", "td", "conv"))}


def _yards(yds: Column, per_point: int, integral: bool) -> Column:
    if integral:  # truncating integer division: points are integers downstream
        return F.call_function("div", yds, F.lit(per_point))
    return yds.cast("double") / F.lit(float(per_point))


def passing_points(yds: Column, intcpt: Column, td: Column, conv: Column,
                   integral: bool = True) -> Column:
    return (_yards(yds, PASS_YARDS_PER_POINT, integral)
            - F.lit(2) * intcpt + F.lit(2) * conv + F.lit(4) * td)


def running_points(yds: Column, td: Column, conv: Column, integral: bool = True) -> Column:
    """Rushing and receiving share one formula."""
    return _yards(yds, RUSH_YARDS_PER_POINT, integral) + F.lit(6) * td + F.lit(2) * conv


def _formulas(get, integral: bool) -> list[Column]:
    return [
        passing_points(get("passing", "yds"), get("passing", "intcpt"), get("passing", "td"),
                       get("passing", "conv"), integral).alias("passing"),
        running_points(get("rushing", "yds"), get("rushing", "td"), get("rushing", "conv"),
                       integral).alias("rushing"),
        running_points(get("receiving", "yds"), get("receiving", "td"),
                       get("receiving", "conv"), integral).alias("receiving"),
    ]


def score_sessions(game_sessions: DataFrame, integral: bool = True,
                   one_row_a_game: bool = False) -> DataFrame:
    """``scoring_game_sessions`` -> (player, gid, passing, rushing, receiving).

    Each array is folded into NULL-aware sums inside one projection; the rows
    of a key (several only where the game id is NULL) are then added up before
    the formulas run on the totals.  A NULL or empty array gives a NULL
    measure, never a dropped row.

    ``one_row_a_game`` says that the sessions are as :func:`sessions.combine`
    makes them, so rows with a game id need no adding up and no shuffle.
    """
    folded = game_sessions.select(
        "player", "gid",
        *[fold_sums(arr, fields).alias(m) for m, (arr, fields) in MEASURES.items()])
    sums = [(F.col(m)[f].cast("bigint"), f"{m}_{f}")
            for m, (_, fields) in MEASURES.items() for f in fields]
    totals = S.add_up(folded, sums) if one_row_a_game else folded.groupBy("player", "gid").agg(
        *[F.sum(value).alias(name) for value, name in sums])
    return totals.select("player", "gid",
                         *_formulas(lambda m, f: F.col(f"{m}_{f}"), integral))


def player_game_points(t: PlayTables, integral: bool = True, method: str = "union") -> DataFrame:
    """The nested path end to end: per-game sessions, then :func:`score_sessions`."""
    return score_sessions(S.scoring_sessions(t, by_game=True, method=method), integral)


def player_game_points_flat(t: PlayTables, integral: bool = True) -> DataFrame:
    """Same result as :func:`player_game_points` without building arrays.

    The enriched plays are summed per (player, gid) with measure-specific
    columns; ``sum`` of no values is NULL, so a player-game without passes gets
    NULL passing exactly as the fold does.  Kicks contribute a row but no
    points.
    """
    sums = [f"sum(CASE WHEN kind = '{arr}' THEN CAST({f} AS BIGINT) END) AS {m}_{f}"
            for m, (arr, fields) in MEASURES.items() for f in fields]
    totals = S.plays(t).groupBy("player", "gid").agg(*[F.expr(x) for x in sums])
    return totals.select("player", "gid", *_formulas(lambda m, f: F.col(f"{m}_{f}"), integral))
