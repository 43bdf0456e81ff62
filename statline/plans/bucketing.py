"""Bucketed layouts: play tables by play id, enriched plays by player.

Play tables bucketed on the play id make the play joins shuffle-free.

Every play operator joins a play table with ``core``, ``scoring_14``,
``convs`` and ``ints``/``fumbles`` on ``pid``.  Over plain files each of
those joins shuffles both sides; at warehouse scale that is several full
shuffles of the largest tables per job.  Written once with
``bucketBy(n, "pid").sortBy("pid")``, the tables are co-partitioned and
pre-sorted, and the sort-merge joins between them read the buckets directly:
no exchange, no sort.  The tables are external tables under the shared
folder, so they survive executor loss and serve later jobs.

Enriched plays bucketed on (player, part) make the nestings shuffle-free: each
of the ten session tables groups by these keys, or by these and the game.  A
player holds at most 1/parts of a bucket's share of its plays, so a hot player
does not make a hot bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from statline.session import scratch_path
from statline.sources.sinks import CODEC
from statline.sources.play_views import PlayTables

PID_TABLES = ("passes", "rushes", "kicks", "core", "scoring", "convs", "ints", "fumbles")


def bucket_play_tables(spark: SparkSession, t: PlayTables, buckets: int,
                       prefix: str | None = None, root: str | None = None) -> PlayTables:
    """Write the pid-keyed tables bucketed by ``pid``; return them as tables.

    ``games`` and ``players`` are keyed differently and are passed through.
    The catalog keeps no name of them; the files stay under ``root``.
    """
    prefix = prefix or f"statline_{uuid.uuid4().hex[:12]}"
    root = root or scratch_path(spark, "bucketed")
    out = {}
    for name in PID_TABLES:
        table_name = f"{prefix}_{name}"
        (getattr(t, name).write.mode("errorifexists")
         .bucketBy(buckets, "pid").sortBy("pid")
         .option("path", f"{root}/{name}")
         .saveAsTable(table_name))
        out[name] = spark.table(table_name)
        # the plan holds the files and their bucketing; the name is not needed
        spark.sql(f"DROP TABLE {table_name}")
    return PlayTables(games=t.games, players=t.players, **out)


PLAY_BUCKET_KEYS = ("player", "part")


def write_enriched_plays(plays: DataFrame, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """One file a bucket, rows sorted by kind, so a reader of one kind skips
    the row groups of others."""
    name = f"statline_{uuid.uuid4().hex[:12]}_plays"
    (plays.repartition(buckets, *PLAY_BUCKET_KEYS).write.mode(mode)
     .bucketBy(buckets, *PLAY_BUCKET_KEYS).sortBy("kind", *PLAY_BUCKET_KEYS)
     .option("path", path).option("compression", CODEC).saveAsTable(name))
    plays.sparkSession.sql(f"DROP TABLE {name}")


def read_enriched_plays(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The plays in ``path`` with their buckets (as many as they were written in)."""
    name = f"statline_{uuid.uuid4().hex[:12]}_plays"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                        for f in spark.read.parquet(path).schema.fields)
    keys = ", ".join(PLAY_BUCKET_KEYS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) "
              f"SORTED BY (kind, {keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    plays = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return plays
