"""Adapters that present the shared TPC-H-style tables as play-by-play tables.

The reference reads warehouse tables ``pass``, ``rush``, ``fgxp``, ``core``,
``scoring_14``, ``convs``, ``ints``, ``fumbles``, ``games`` and ``players``.
The test data has none of them, so these views derive them from
``lineitem`` (one play per line item), ``orders`` (one game per order) and
``part`` (one player per part).  The DuckDB oracle defines the same views in
SQL (:mod:`statline.plans.oracle`).

Deterministic injections exercise the NULL and placeholder rules: a few
player ids become the placeholder ``XX-0000``, a few receivers and game ids
NULL, and one game has the id 0 that NULL game ids count as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.functions.positions import NO_PLAYER
from statline.sources.tables import table
from statline.sources.warehouse import PlayTables

# ---------------------------------------------------------------------------
# Fixed values of the adapter (shared with the SQL oracle).
TARGET_YEAR = 2000
# Raw position of part p is RAW_POSITIONS[p % 11]; the last one is NULL.
RAW_POSITIONS = ("RB", "QB", "DB", "DL", "K", "LB", "OL", "TE", "WR", "LS", None)
PLACEHOLDER_EVERY = 97     # part keys divisible by this become the placeholder id
NULL_RECEIVER_EVERY = 23   # supplier keys divisible by this become a NULL receiver
NULL_GAME_EVERY = 89       # order keys divisible by this become a NULL game of the play
ZERO_GAME_ORDER = 7        # the order whose game has the id 0, where NULL games go
# ---------------------------------------------------------------------------


def _player_id(key: Column) -> Column:
    return F.when(key % PLACEHOLDER_EVERY == 0, F.lit(NO_PLAYER)).otherwise(key.cast("string"))


def _lineitem(spark: SparkSession, data_dir: str) -> DataFrame:
    li = table(spark, data_dir, "lineitem")
    return li.withColumn(
        "pid", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def _pids(li: DataFrame, cond: Column) -> DataFrame:
    # Plain filters, no DISTINCT: play ids are unique in the line items except
    # for rare repeated rows at the smallest scale, which then fan out in the
    # joins exactly as repeated rows of a warehouse table would (the SQL
    # oracle defines the views the same way).  No shuffle is spent here.
    return li.filter(cond).select("pid")


def play_tables(spark: SparkSession, data_dir: str) -> PlayTables:
    li = _lineitem(spark, data_dir)
    passes = li.filter(F.col("l_returnflag") == "A").select(
        "pid",
        _player_id(F.col("l_partkey")).alias("psr"),
        F.when(F.col("l_suppkey") % NULL_RECEIVER_EVERY == 0, F.lit(None).cast("string"))
        .otherwise(F.col("l_suppkey").cast("string")).alias("trg"),
        F.col("l_quantity").cast("int").alias("yds"),
    )
    rushes = li.filter(F.col("l_returnflag") == "N").select(
        "pid", _player_id(F.col("l_partkey")).alias("bc"),
        F.col("l_quantity").cast("int").alias("yds"))
    kicks = li.filter(F.col("l_returnflag") == "R").select(
        "pid", _player_id(F.col("l_partkey")).alias("fkicker"),
        F.col("l_linestatus").alias("fgxp"),
        F.col("l_quantity").cast("int").alias("dist"),
        F.when(F.col("l_tax") > 0, F.lit("Y")).otherwise(F.lit("N")).alias("good"))
    core = li.select("pid", F.when(F.col("l_orderkey") % NULL_GAME_EVERY != 0,
                                   F.col("l_orderkey")).alias("gid"))
    scoring = _pids(li, F.col("l_discount") >= 0.08).withColumn("pts", F.lit(6))
    convs = _pids(li, F.col("l_discount") == 0.01)
    ints = _pids(li, (F.col("l_discount") == 0.02) & (F.col("l_returnflag") == "A"))
    fumbles = _pids(li, (F.col("l_discount") == 0.02) & (F.col("l_returnflag") == "N"))
    games = table(spark, data_dir, "orders").select(
        F.when(F.col("o_orderkey") == ZERO_GAME_ORDER, F.lit(0)).otherwise(F.col("o_orderkey"))
        .cast("bigint").alias("gid"), F.year("o_orderdate").cast("int").alias("seas"))
    positions = F.array(*[F.lit(p).cast("string") for p in RAW_POSITIONS])
    players = table(spark, data_dir, "part").select(
        F.col("p_partkey").cast("string").alias("player"),
        F.element_at(positions, (F.col("p_partkey") % len(RAW_POSITIONS) + 1).cast("int"))
        .alias("pos1"))
    return PlayTables(passes, rushes, kicks, core, scoring, convs, ints, fumbles, games, players)
