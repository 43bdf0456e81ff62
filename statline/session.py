"""Session helpers: sensible defaults for tests and the benchmark, and the
shared folder used for checkpoints and sink round trips."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "statline") -> SparkSession:
    """Local session with AQE (coalescing and skew-join splitting) on.

    On a cluster, pass nothing: the builder then keeps the cluster's master
    and shuffle settings.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local-mode session that names none (tests) gets a private folder;
    on a cluster a machine-local folder would be wrong, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="statline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Make ``DataFrame.checkpoint()`` usable; returns the checkpoint root
    (None when the server side owns it, as with Spark Connect)."""
    sc = _context(spark)
    if sc is None:
        return None
    current = sc.getCheckpointDir()
    if current:
        return current
    root = shared_dir(spark)
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared directory."""
    return os.path.join(shared_dir(spark), "statline", f"{name}-{uuid.uuid4().hex}")
