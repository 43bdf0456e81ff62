"""Sinks: Parquet, JSON lines, text and CSV, with the reference's write modes.

An output that exists is an error for plain CREATE TABLE AS and for output
folders; CREATE TABLE IF NOT EXISTS leaves it as it is.  A folder without the
committer's ``_SUCCESS`` marker was left by a job that died: it is no table,
and taking it for one is an error.  Paths should live in shared storage.

Sinks with a folder for each value of a column deal their rows out by it first
(``rebalance``): the number of files follows the bytes (the session's advisory
partition size), small values share no file, a large value has several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "errorifexists"

# Codec of stored tables: play ids hardly repeat, which snappy leaves almost as
# they are; zstd stores their digits in about two thirds of the bytes.
CODEC = "zstd"

SUMMARY = T.StructType([T.StructField("mean", T.DoubleType()),
                        T.StructField("variance", T.DoubleType())])
STATS_BY_YEAR = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("totalGamesPlayed", T.IntegerType()),
    T.StructField("passingStats", SUMMARY),
    T.StructField("receivingStats", SUMMARY),
    T.StructField("rushingStats", SUMMARY),
    T.StructField("totalStats", SUMMARY),
])
PLAYER_YEARLY_STATS = T.StructType([
    T.StructField("playerId", T.StringType()),
    T.StructField("statsByYear", T.ArrayType(STATS_BY_YEAR)),
])
ROSTER_STATS = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("qb", "rb1", "rb2", "wr1", "wr2", "te", "k", "flex", "def")]
    + [T.StructField("meanTotal", T.DoubleType()),
       T.StructField("varianceTotal", T.DoubleType())])
EXTRACT_SCHEMA = T.StructType([
    T.StructField("player", T.StringType()),
    T.StructField("seas", T.IntegerType()),
    T.StructField("totalPts", T.LongType()),
    T.StructField("stddev", T.DoubleType()),
])


class IncompleteTable(RuntimeError):
    """A folder that a job has begun to write and not finished."""


ABSENT, PARTIAL, WHOLE = "absent", "partial", "whole"


def table_state(spark: SparkSession, path: str) -> str:
    """Whether a folder is absent, was begun (no ``_SUCCESS``), or is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return ABSENT
    return WHOLE if fs.exists(hadoop.Path(folder, "_SUCCESS")) else PARTIAL


def _refuse_partial(spark: SparkSession, path: str) -> str:
    state = table_state(spark, path)
    if state == PARTIAL:
        raise IncompleteTable(f"{path} holds no _SUCCESS: a job that wrote it did not finish")
    return state


def create_table_as(df: DataFrame, path: str, if_not_exists: bool = False,
                    mode: str = ERROR) -> None:
    """Parquet CTAS: fails when present, or is skipped with ``if_not_exists``;
    ``mode="overwrite"`` writes a half-written folder anew."""
    if mode == ERROR and _refuse_partial(df.sparkSession, path) == WHOLE and if_not_exists:
        return
    df.write.mode(mode).option("compression", CODEC).parquet(path)


def create_named_table(df: DataFrame, name: str, path: str, if_not_exists: bool = False,
                       mode: str = ERROR) -> None:
    """CTAS into a named table of a database, with its files in ``path``.

    The name appears in the catalog after the files are whole; a name that
    exists is an error, or is left as it is with ``if_not_exists``."""
    spark = df.sparkSession
    if mode == ERROR:
        if spark.catalog.tableExists(name):
            if if_not_exists:
                return
        elif _refuse_partial(spark, path) == WHOLE:
            raise FileExistsError(f"{path} holds a table without a name")
    (df.write.mode(mode).option("path", path).option("compression", CODEC).format("parquet")
     .saveAsTable(name))


def write_player_yearly_stats(yearly: DataFrame, path: str, mode: str = ERROR) -> None:
    """Nested ``PlayerYearlyStats`` records as Parquet."""
    yearly.select("playerId", "statsByYear").write.mode(mode).parquet(path)


def write_rosters(rosters: DataFrame, path: str, mode: str = ERROR) -> None:
    """``RosterStats`` records (eleven flat columns) as Parquet."""
    rosters.select(*ROSTER_STATS.fieldNames()).write.mode(mode).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = ERROR) -> None:
    """Each record as one JSON text line, fields in record order."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_position_groups(groups: DataFrame, path: str, mode: str = ERROR) -> None:
    """One JSON dataset per position group in a single job (``slot=`` folders;
    the flex name ``WR/TE/RB`` is escaped in the folder name and reads back
    intact)."""
    (groups.select("slot", F.col("player_id").alias("playerId"), "statsByYear")
     .hint("rebalance", "slot").write.mode(mode).partitionBy("slot").json(path))


def write_key_counts(counts: DataFrame, key: str, count: str, path: str,
                     mode: str = ERROR) -> None:
    """``key,count`` text lines; a NULL key is written as the empty key, a
    NULL count as an empty count."""
    (counts.select(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit(","),
                            F.coalesce(F.col(count).cast("string"), F.lit(""))).alias("value"))
     .write.mode(mode).text(path))


def read_key_counts(spark: SparkSession, path: str, key: str, count: str) -> DataFrame:
    """Inverse of :func:`write_key_counts`; the key may be empty or hold commas,
    and what is no number is a NULL count."""
    line = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(line, r"(?s)^(.*),[^,]*$", 1).alias(key),
        F.substring_index(line, ",", -1).try_cast("bigint").alias(count))


def write_position_extract(extract: DataFrame, path: str, mode: str = ERROR) -> None:
    """Tab-separated text, one folder per position (``pos1=``)."""
    (extract.select(*EXTRACT_SCHEMA.fieldNames(), "pos1").hint("rebalance", "pos1")
     .write.mode(mode).partitionBy("pos1").option("sep", "\t").csv(path))


def read_position_extract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTRACT_SCHEMA).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = ERROR) -> None:
    """Plain CSV rows without header (the injury rows sink)."""
    df.write.mode(mode).csv(path)
