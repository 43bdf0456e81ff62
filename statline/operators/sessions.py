"""Nested play sessions: the plays of a player (or of a player in one game)
gathered into one array of structs, and the full outer combination of the
four kinds of session.

All kinds of play come from one enrichment pipeline: passes, rushes and made
kicks are stacked as narrow rows and joined once each with ``core``,
``scoring_14``, ``convs``, ``ints`` and ``fumbles`` on the play id.

Scale: the layout never depends on the data.

* A play belongs to one of ``parts`` parts of its player, hot or not: by a hash
  of its game, or of its play id if it has no game.  The enriched plays with
  that part are all that a nesting needs: stored in buckets of (player, part),
  they give every session table without a shuffle (see ``plans/bucketing``).
* Per game there is one row per (player, gid), which lies in one part; a game
  bounds its arrays.  Only plays without a game id have no such bound: they are
  spread over the parts (NULL keys never match each other, so no consumer can
  tell these rows from those of a full outer join).
* Per player there are up to ``parts`` rows; parts hold disjoint games, and sums
  and sizes add up across parts.  ``parts=1`` gives one row per player, for
  tables whose players are known to be small.

Arrays are in order of play id (then of the other fields), so a table does not
depend on how its rows were dealt.  Nothing runs while a session table is being
built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.functions.positions import NO_PLAYER
from statline.sources.play_views import PlayTables

PARTS = 16

KINDS = ("passes", "rushes", "receptions", "fgxp")

# Element fields of each session array (gid is dropped in the per-game form).
FIELDS = {
    "passes": ("pid", "gid", "yds", "intcpt", "td", "conv"),
    "rushes": ("pid", "gid", "yds", "td", "conv"),
    "receptions": ("pid", "gid", "yds", "td", "conv"),
    "fgxp": ("pid", "gid", "fgxp", "dist"),
}


def _flag(side: DataFrame, name: str) -> DataFrame:
    return side.select(F.col("pid").alias(f"_{name}_pid"), F.lit(1).alias(name))


def _raw_plays(t: PlayTables, kinds: Sequence[str]) -> DataFrame:
    """The wanted play tables stacked: (src, pid, who, target, yds, fgxp, dist)."""
    parts = []
    if "passes" in kinds or "receptions" in kinds:
        parts.append(t.passes.selectExpr(
            "'pass' AS src", "pid", "psr AS who", "trg AS target", "yds",
            "CAST(NULL AS STRING) AS fgxp", "CAST(NULL AS INT) AS dist"))
    if "rushes" in kinds:
        parts.append(t.rushes.selectExpr(
            "'rush' AS src", "pid", "bc AS who", "CAST(NULL AS STRING) AS target", "yds",
            "CAST(NULL AS STRING) AS fgxp", "CAST(NULL AS INT) AS dist"))
    if "fgxp" in kinds:
        parts.append(t.kicks.filter(F.col("good") == "Y").selectExpr(
            "'kick' AS src", "pid", "fkicker AS who", "CAST(NULL AS STRING) AS target",
            "CAST(NULL AS INT) AS yds", "fgxp", "dist"))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.filter((F.col("who") != NO_PLAYER) | (F.col("target") != NO_PLAYER))


def plays(t: PlayTables, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Enriched plays of the wanted kinds, one row per play and role:
    (kind, player, gid, pid, yds, intcpt, td, conv, fgxp, dist).

    A pass is a ``passes`` row of its passer and, when no interception matched
    (LEFT JOIN ... IS NULL, row for row the anti join), a ``receptions`` row
    of its target; a rush counts when no fumble matched; kicks take nothing
    but their game.  The left joins fan out when a side table repeats a pid,
    as in the reference; conditions on ``src`` keep a side table from touching
    kinds that the reference does not join with it.
    """
    df = _raw_plays(t, kinds).join(t.core.select("pid", "gid"), "pid", "inner")
    src, pid = F.col("src"), F.col("pid")
    if kinds != ("fgxp",) and set(kinds) != {"fgxp"}:
        pts = t.scoring.select(F.col("pid").alias("_pts_pid"), "pts")
        df = df.join(pts, (pid == F.col("_pts_pid")) & (src != "kick"), "left")
        df = df.join(_flag(t.convs, "conv"), (pid == F.col("_conv_pid")) & (src != "kick"), "left")
    else:
        df = df.withColumns({"pts": F.lit(None).cast("int"), "conv": F.lit(None).cast("int")})
    for name, side, table, wanted in (("int", "pass", t.ints, ("passes", "receptions")),
                                      ("fumble", "rush", t.fumbles, ("rushes",))):
        if set(wanted) & set(kinds):
            df = df.join(_flag(table, name), (pid == F.col(f"_{name}_pid")) & (src == side), "left")
        else:
            df = df.withColumn(name, F.lit(None).cast("int"))
    roles = []
    for kind, cond, player in (
            ("passes", src == "pass", "who"),
            ("receptions", (src == "pass") & F.col("int").isNull(), "target"),
            ("rushes", (src == "rush") & F.col("fumble").isNull(), "who"),
            ("fgxp", src == "kick", "who")):
        if kind in kinds:
            role = F.struct(F.lit(kind).alias("kind"), F.col(player).alias("player"))
            roles.append(F.when(cond & (F.col(player) != NO_PLAYER), role))
    run = src != "kick"
    return (df.withColumn("role", F.explode(F.array_compact(F.array(*roles)))).select(
        "role.kind", "role.player", "gid", "pid", "yds",
        F.when(src == "pass", F.col("int").isNotNull().cast("int")).alias("intcpt"),
        F.when(run, F.coalesce(F.col("pts"), F.lit(0)).cast("int")).alias("td"),
        F.when(run, F.col("conv").isNotNull().cast("int")).alias("conv"), "fgxp", "dist"))


def _one_kind(t: PlayTables, kind: str) -> DataFrame:
    """Plays of one kind: (player, gid, pid, fields)."""
    return plays(t, (kind,)).select("player", *dict.fromkeys(("gid", "pid", *FIELDS[kind])))


def pass_plays(t: PlayTables) -> DataFrame:
    """Pass plays by passer: (player, gid, pid, yds, intcpt, td, conv)."""
    return _one_kind(t, "passes")


def reception_plays(t: PlayTables) -> DataFrame:
    """Completed receptions by target, intercepted plays removed."""
    return _one_kind(t, "receptions")


def rush_plays(t: PlayTables) -> DataFrame:
    """Rushes by ball carrier, fumbled plays removed."""
    return _one_kind(t, "rushes")


def kick_plays(t: PlayTables) -> DataFrame:
    """Made kicks by kicker: (player, gid, pid, fgxp, dist)."""
    return _one_kind(t, "fgxp")


def in_parts(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """Plays with the part of their player that they belong to."""
    key = F.when(F.col("gid").isNull(), F.xxhash64("pid")).otherwise(F.xxhash64("gid"))
    return df.withColumn("part", F.pmod(key, F.lit(parts)).cast("int"))


def enriched(t: PlayTables, kinds: Sequence[str] = KINDS, parts: int = PARTS) -> DataFrame:
    """Every play of the wanted kinds with its part: what the nestings read."""
    return in_parts(plays(t, kinds), parts)


def _keys(by_game: bool) -> list[str]:
    return ["player", "gid"] if by_game else ["player", "part"]


def _group(by_game: bool) -> list[str]:
    return ["player", "part", "gid"] if by_game else ["player", "part"]


def _fields(kind: str, by_game: bool) -> list[str]:
    return [f for f in FIELDS[kind] if not (by_game and f == "gid")]


def dealt(enriched_plays: DataFrame, by_game: bool = False) -> DataFrame:
    """Plays dealt out by the keys of a nesting, which then needs no shuffle.

    A nesting gathers every play, so gathering some before the shuffle saves no
    rows and sends each play as an array of its own; the plain rows are smaller."""
    return enriched_plays.repartition(*_group(by_game))


def _arrays(enriched_plays: DataFrame, kind: str, by_game: bool) -> DataFrame:
    return (enriched_plays.filter(F.col("kind") == kind).groupBy(*_group(by_game))
            .agg(F.sort_array(F.collect_list(F.struct(*_fields(kind, by_game)))).alias(kind)))


def nest(enriched_plays: DataFrame, kind: str, by_game: bool = False) -> DataFrame:
    """One session table from enriched plays: (player, gid | part, <kind>)."""
    return _arrays(enriched_plays, kind, by_game).select(*_keys(by_game), kind)


def combine(enriched_plays: DataFrame, by_game: bool = False,
            kinds: Sequence[str] = KINDS) -> DataFrame:
    """The sessions of all kinds side by side, by one grouping:
    ``collect_list`` skips the other kinds' NULLs, and an array with no element
    is NULL.  Rows whose key has a NULL are kept apart per kind, as a full outer
    join never matches NULL keys."""
    no_match = F.when(F.col("gid").isNull(), F.col("kind")) if by_game else F.lit(None)
    elements = {k: F.when(F.col("kind") == k, F.struct(*_fields(k, by_game))) for k in kinds}
    return enriched_plays.groupBy(
        *_group(by_game), no_match.cast("string").alias("_null_key_kind")).agg(*[
            F.when(F.count(e) > 0, F.sort_array(F.collect_list(e))).alias(k)
            for k, e in elements.items()]).select(*_keys(by_game), *kinds)


def add_up(per_row: DataFrame, sums: Sequence[tuple[Column, str]],
           least: Sequence[tuple[Column, str]] = (),
           greatest: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """One row per (player, gid) of what was taken from the rows of a per-game
    session table.  A game id stands in one row of its player, so only the rows
    without one (several a player) are grouped, and only they are shuffled."""
    cols = [*sums, *least, *greatest]
    how = [F.sum] * len(sums) + [F.min] * len(least) + [F.max] * len(greatest)
    games = per_row.filter(F.col("gid").isNotNull()).select(
        "player", "gid", *[value.alias(name) for value, name in cols])
    none = per_row.filter(F.col("gid").isNull()).groupBy("player", "gid").agg(
        *[f(value).alias(name) for f, (value, name) in zip(how, cols)])
    return games.unionByName(none)


def sessions(t: PlayTables, kind: str, by_game: bool = False, parts: int = PARTS) -> DataFrame:
    """One session table: kind in passes, rushes, receptions, fgxp.

    Per game: (player, gid, <kind>).  Per player: (player, part, <kind>)."""
    return nest(dealt(enriched(t, (kind,), parts), by_game), kind, by_game)


def scoring_sessions(t: PlayTables, by_game: bool = False, parts: int = PARTS,
                     method: str = "union", kinds: Sequence[str] = KINDS) -> DataFrame:
    """The sessions of every player (and game) side by side; a missing array
    stays NULL.  ``kinds`` leaves out what a consumer does not read.

    ``method="join"`` is the reference's form: nest each kind, then
    ``(receptions ⟗ fgxp) ⟗ (rushes ⟗ passes)`` (USING joins coalesce the
    keys).  The part of a game depends on its id alone, so it may stand among
    the keys: the first joins then find the nestings dealt out by their keys,
    and only the two halves are shuffled again.  ``method="union"`` (default)
    gives the same rows with one shuffle (see :func:`combine`).
    """
    if method == "join":
        order = [k for k in ("receptions", "fgxp", "rushes", "passes") if k in kinds]
        level = [_arrays(dealt(enriched(t, (kind,), parts), by_game), kind, by_game)
                 for kind in order]
        while len(level) > 1:
            level = [reduce(lambda a, b: a.join(b, _group(by_game), "full"), level[i:i + 2])
                     for i in range(0, len(level), 2)]
        return level[0].select(*_keys(by_game), *kinds)
    return combine(dealt(enriched(t, kinds, parts), by_game), by_game, kinds)
