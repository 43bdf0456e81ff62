"""Property tests: the array fold equals SQL sum; results do not depend on
the number of shuffle partitions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statline.functions.arrays import fold_sums
from statline.plans.registry import queries

from shared_tables import SF_SMALL

elem = st.tuples(st.one_of(st.none(), st.integers(-1000, 1000)),
                 st.one_of(st.none(), st.integers(0, 6)))
arrays = st.one_of(st.none(), st.lists(elem, max_size=8))


@settings(max_examples=15, deadline=None)
@given(st.lists(arrays, min_size=1, max_size=6))
def test_fold_equals_sql_sum(spark, rows):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)],
                               "id int, a array<struct<yds:int, td:int>>")
    folded = {r.id: (r.s.yds, r.s.td) if r.s is not None else (None, None)
              for r in df.select("id", fold_sums("a", ["yds", "td"]).alias("s")).collect()}
    flat = df.select("id", F.explode_outer("a").alias("e")).groupBy("id").agg(
        F.sum(F.col("e")["yds"]).alias("yds"), F.sum(F.col("e")["td"]).alias("td"))
    summed = {r.id: (r.yds, r.td) for r in flat.collect()}
    assert folded == summed


def test_partition_count_independence(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = queries()["season_stats"](spark, SF_SMALL).collect()
            got.append(sorted(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[0]) > 100 and got[0] == got[1]
