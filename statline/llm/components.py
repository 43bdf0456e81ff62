"""Connected components by minimum label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: a cut of the
    lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest reachable node) of edges (a, b).

    A round takes the least label of all neighbours, then the label of that
    label, so long chains shrink fast; labels are aggregated map-side first.
    """
    both = stored(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp"))
                    .withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a")
                .agg(F.min("comp").alias("near")))
        new = (labels.join(near, labels["node"] == near["a"])
               .select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        up = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = stored(new.join(up, new["comp"] == up["via"], "left").select(
            "node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels
