"""Where a job's outputs go, and which of them are done.

A store writes each output (a step) to a folder of its root, and, with a
database, gives tables their names there, so later steps and other jobs read
them by name.  Later steps read what was written, not its plan.

With ``resume`` a store keeps a ledger beside the outputs: one small record per
step, written after the step's output is whole, with a fingerprint of the
inputs (files, their lengths and times, and the job's parameters).  A job that
died is started again with the same inputs and goes on after its last recorded
step; what it had begun is written anew.  With other inputs it is refused,
since its outputs would mix two states of the data.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.plans.bucketing import read_enriched_plays, write_enriched_plays
from statline.sources import sinks as K

# ---------------------------------------------------------------------------
# The tables' names in a database.
TABLE_NAMES = {
    "sessions_passes": "passing_sess",
    "sessions_passes_by_game": "passing_game_sess",
    "sessions_rushes": "rushing_sess",
    "sessions_rushes_by_game": "rushing_game_sess",
    "sessions_receptions": "receiving_sess",
    "sessions_receptions_by_game": "receiving_game_sess",
    "sessions_fgxp": "fgxp_sess",
    "sessions_fgxp_by_game": "fgxp_game_sess",
    "sessions_all": "scoring_sessions",
    "sessions_all_by_game": "scoring_game_sessions",
    "game_points": "player_game_points",
    "season_prediction": "player_prediction",
}
# ---------------------------------------------------------------------------


class ChangedInputs(RuntimeError):
    """A job is resumed with inputs that its finished steps were not built from."""


def fingerprint(inputs: Sequence[DataFrame], **parameters) -> str:
    """A digest of the inputs' files (path, length, time of change) and of the
    parameters.  Spark lists the files; their contents are not read."""
    files = sorted({f for df in inputs for f in df.inputFiles()})
    if not files:
        raise ValueError("inputs without files have no fingerprint to resume by")
    spark = inputs[0].sparkSession
    found = (spark.read.format("binaryFile").load(files)
             .select(F.xxhash64("path", "length", "modificationTime").alias("h"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first())
    state = json.dumps([found.n, str(found.s), parameters], sort_keys=True, default=str)
    return hashlib.sha256(state.encode()).hexdigest()


class Store:
    """Outputs under ``root``; named tables of ``database`` if one is given.

    ``reuse`` takes an existing whole table as it is (CREATE TABLE IF NOT
    EXISTS); ``resume`` is the fingerprint of the inputs of a job that may be
    continued.  Without either, an output that exists is an error."""

    def __init__(self, spark: SparkSession, root: str, database: str | None = None,
                 reuse: bool = False, resume: str | None = None):
        self.spark, self.root, self.database = spark, root.rstrip("/"), database
        self.reuse, self.resume = reuse, resume
        if database:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.path('_database')}'")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _record(self, name: str) -> str:
        return self.path(f"_ledger/{name}")

    def done(self, name: str) -> bool:
        """Whether a resumed job has finished this step from these inputs."""
        if self.resume is None or K.table_state(self.spark, self._record(name)) != K.WHOLE:
            return False
        record = json.loads(self.spark.read.text(self._record(name)).first().value)
        if record["inputs"] != self.resume:
            raise ChangedInputs(f"step {name} in {self.root} was built from other inputs")
        return K.table_state(self.spark, self.path(name)) == K.WHOLE

    def write(self, name: str, write: Callable[[str, str], None]) -> None:
        """Runs ``write(path, mode)`` unless the step is done, and records it."""
        if self.done(name):
            return
        write(self.path(name), K.ERROR if self.resume is None else "overwrite")
        if self.resume is not None:
            record = json.dumps({"step": name, "inputs": self.resume})
            (self.spark.range(1).select(F.lit(record).alias("value")).coalesce(1)
             .write.mode("overwrite").text(self._record(name)))

    def table(self, name: str) -> DataFrame:
        """A written table: by its name, or its folder where it has none."""
        if self.database and name in TABLE_NAMES:
            return self.spark.table(f"{self.database}.{TABLE_NAMES[name]}")
        return self.spark.read.parquet(self.path(name))

    def create(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """CREATE TABLE AS of what ``build`` plans; returns the written table."""
        def write(path: str, mode: str) -> None:
            if self.database and name in TABLE_NAMES:
                K.create_named_table(build(), f"{self.database}.{TABLE_NAMES[name]}", path,
                                     self.reuse, mode)
            else:
                K.create_table_as(build(), path, self.reuse, mode)

        self.write(name, write)
        return self.table(name)

    def plays(self, build: Callable[[], DataFrame], buckets: int) -> DataFrame:
        """The enriched plays, written once in buckets of player and part."""
        name = f"plays_in_{buckets}"

        def write(path: str, mode: str) -> None:
            if self.reuse and K.table_state(self.spark, path) == K.WHOLE:
                return
            write_enriched_plays(build(), path, buckets, mode)

        self.write(name, write)
        return read_enriched_plays(self.spark, self.path(name), buckets)
