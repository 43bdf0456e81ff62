"""The in-row scoring functions as Spark SQL functions.

``register_sql_functions(spark)`` creates temporary SQL functions, so that
per-game sessions can be scored from ``spark.sql``.  They play the role of
the in-row functions the reference registers for its SQL.  Each is a
SQL-bodied function: Catalyst inlines its expression into the plan, so it
runs in generated code like any built-in (no Python, no serialisation).

    pass_sums(passes)        -> struct<yds, intcpt, td, conv>   NULL-aware sums
    run_sums(rushes)         -> struct<yds, td, conv>           (rushes, receptions)
    passing_points(yds, intcpt, td, conv) -> bigint
    running_points(yds, td, conv)         -> bigint
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from statline.operators.scoring import PASS_YARDS_PER_POINT, RUSH_YARDS_PER_POINT

_PASS_ELEM = "STRUCT<pid: STRING, yds: INT, intcpt: INT, td: INT, conv: INT>"
_RUN_ELEM = "STRUCT<pid: STRING, yds: INT, td: INT, conv: INT>"


def _fold(fields: tuple[str, ...]) -> str:
    init = ", ".join(f"'{f}', CAST(NULL AS BIGINT)" for f in fields)
    step = ", ".join(
        f"'{f}', CASE WHEN x.{f} IS NULL THEN acc.{f} ELSE coalesce(acc.{f}, 0) + x.{f} END"
        for f in fields)
    return f"aggregate(arr, named_struct({init}), (acc, x) -> named_struct({step}))"


def _struct(fields: tuple[str, ...]) -> str:
    return "STRUCT<" + ", ".join(f"{f}: BIGINT" for f in fields) + ">"


PASS_FIELDS = ("yds", "intcpt", "td", "conv")
RUN_FIELDS = ("yds", "td", "conv")


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION pass_sums(arr ARRAY<{_PASS_ELEM}>)
        RETURNS {_struct(PASS_FIELDS)} RETURN {_fold(PASS_FIELDS)}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION run_sums(arr ARRAY<{_RUN_ELEM}>)
        RETURNS {_struct(RUN_FIELDS)} RETURN {_fold(RUN_FIELDS)}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION passing_points(
            yds BIGINT, intcpt BIGINT, td BIGINT, conv BIGINT)
        RETURNS BIGINT
        RETURN (yds div {PASS_YARDS_PER_POINT}) - 2 * intcpt + 2 * conv + 4 * td""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION running_points(yds BIGINT, td BIGINT, conv BIGINT)
        RETURNS BIGINT
        RETURN (yds div {RUSH_YARDS_PER_POINT}) + 6 * td + 2 * conv""")
    return ["pass_sums", "run_sums", "passing_points", "running_points"]
