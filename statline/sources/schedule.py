"""Headerless game-schedule CSV: week, weekday, "Month day" text, team, an
always-empty column, opponent.  The year is not in the rows; it comes from
the file (here: a ``season=YYYY`` folder, found by partition discovery)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEDULE_SCHEMA = T.StructType([
    T.StructField("week", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("date_text", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("unused", T.StringType()),
    T.StructField("opponent", T.StringType()),
])


def schedule_rows(lines: DataFrame) -> DataFrame:
    """Rows of the schema and a season, with the date of text and season; a
    text that is no date gives NULL rather than failing the job."""
    return lines.select(
        "week", "weekday",
        F.try_to_date(F.concat_ws(" ", F.col("date_text"), F.col("season").cast("string")),
                      "MMMM d yyyy").alias("game_date"),
        "team", "opponent", "season")


def read_schedule(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """(week, weekday, game_date, team, opponent, season).

    ``year`` is used when the files are not under ``season=`` folders.  Fields
    that do not fit are NULL; ``rejects.read_schedule`` keeps such lines apart.
    """
    df = spark.read.schema(SCHEDULE_SCHEMA).option("header", "false").csv(path)
    season = F.col("season").cast("int") if "season" in df.columns else F.lit(year).cast("int")
    return schedule_rows(df.withColumn("season", season))


def write_schedule(lines: DataFrame, path: str) -> None:
    """One text folder per season, like one schedule file per year."""
    lines.write.mode("errorifexists").partitionBy("season").text(path)
