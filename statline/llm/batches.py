"""Size of the Arrow batches that texts travel in."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 2_000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def for_texts(spark: SparkSession) -> SparkSession:
    """Texts of some KB make Spark's default of 10,000 rows a batch tens of MB,
    held several times in each task; a session with larger batches gets
    ``ROWS``, one with smaller ones keeps them."""
    rows = int(spark.conf.get(_KEY, "10000"))
    if rows <= 0 or rows > ROWS:
        spark.conf.set(_KEY, str(ROWS))
    return spark
