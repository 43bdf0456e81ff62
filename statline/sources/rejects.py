"""Records that do not fit their schema, kept apart instead of lost as NULLs.

A reader with rejects returns two tables: the good records, and the rejected
ones as they came, each with its reasons.  A table of counts by reason goes
beside the rejects, so a job can refuse to go on when there are too many.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.sources import sinks as K
from statline.sources.schedule import SCHEDULE_SCHEMA, schedule_rows

REASONS = "_reasons"
_FIELDS = len(SCHEDULE_SCHEMA.fields)


def _reasons(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that a record fails (a NULL check fails nothing)."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def split(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with an array of reasons)."""
    if REASONS in df.columns:
        raise ValueError(f"the table has a column {REASONS}")
    marked = df.withColumn(REASONS, _reasons(checks))
    return (marked.filter(F.size(REASONS) == 0).drop(REASONS),
            marked.filter(F.size(REASONS) > 0))


def typed(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Columns cast to their types; rows with a value that is none of its type
    are rejected as they came.  A NULL is a value of every type."""
    checks = {f"{c}: no {t}": F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()
              for c, t in types.items()}
    good, bad = split(df, checks)
    return good.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c)
                         for c in df.columns]), bad


def read_schedule(spark: SparkSession, path: str, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Schedule rows as :func:`statline.sources.schedule.read_schedule` has
    them, and the lines that are none: another number of fields, a week that is
    no number, a date that is none."""
    names = [f.name for f in SCHEDULE_SCHEMA.fields]
    lines = spark.read.text(path)
    texts = ", ".join(f"{n} string" for n in names)
    # every line has all fields at least as text; one field more shows extra ones
    parsed = F.from_csv("value", f"{texts}, _more string", {"mode": "PERMISSIVE"})
    season = F.col("season").cast("int") if "season" in lines.columns else F.lit(year).cast("int")
    rows = lines.select("value", season.alias("season"), parsed.alias("f"))
    count = F.size(F.split(F.regexp_replace("value", r'"[^"]*"', ""), ",", -1))
    date = F.try_to_date(F.concat_ws(" ", F.col("f.date_text"), F.col("season").cast("string")),
                         "MMMM d yyyy")
    good, bad = split(rows, {
        "fields": count != _FIELDS,
        "week": F.col("f.week").isNotNull() & F.col("f.week").try_cast("int").isNull(),
        "date": F.col("f.date_text").isNotNull() & date.isNull()})
    typed_rows = good.select(*[F.col(f"f.{f.name}").cast(f.dataType).alias(f.name)
                               for f in SCHEDULE_SCHEMA.fields], "season")
    return schedule_rows(typed_rows), bad.select("season", F.col("value").alias("line"), REASONS)


def points(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Game points with integer games and points; others are rejected."""
    return typed(df, {"gid": "bigint", "passing": "int", "rushing": "int", "receiving": "int"})


def games(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games with integer ids and seasons; others are rejected."""
    return typed(df, {"gid": "bigint", "seas": "int"})


def counts(rejected: DataFrame) -> DataFrame:
    """(reason, records) of rejected records."""
    return (rejected.select(F.explode(REASONS).alias("reason")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("records")))


def write(rejected: DataFrame, path: str) -> None:
    """Rejected records as JSON lines under ``path/records``, and their counts
    by reason under ``path/counts``."""
    K.write_json_lines(rejected, f"{path}/records")
    K.write_key_counts(counts(rejected), "reason", "records", f"{path}/counts")


def at_most(rejected: DataFrame, limit: int) -> None:
    """Fails when more than ``limit`` records are rejected."""
    found = rejected.limit(limit + 1).count()
    if found > limit:
        raise ValueError(f"more than {limit} records are rejected")
