import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[4]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="statline-wh-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # tests only: a private checkpoint folder when the session names none
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="statline-test-"))
    from statline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    yield spark
    spark.stop()


@pytest.fixture()
def out_dir():
    return tempfile.mkdtemp(prefix="statline-out-")
