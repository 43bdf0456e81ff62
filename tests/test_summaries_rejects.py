"""Merged season moments, and records that do not fit their schema."""

import os

import pytest

from statline.operators import stats as ST
from statline.operators import summaries as SM
from statline.sources import rejects as RJ
from statline.sources import sinks as K

POINTS = "player string, gid long, passing int, rushing int, receiving int"


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_merge_exactly(spark, out_dir):
    data = [(f"p{i % 7}", i % 30, i * 37 % 101, i % 13, -(i % 5)) for i in range(400)] + [("p1", None, 3, None, 1)]
    points = spark.createDataFrame(data, POINTS)
    games = spark.createDataFrame([(i, 2000 + i % 3) for i in range(30)], "gid long, seas int")
    cuts = [data[:1], data[1:150], data[150:], []]
    for i, part in enumerate(cuts):
        SM.add(spark.createDataFrame(part, POINTS), games, out_dir, f"w{i}")
    want = rows(ST.season_stats(points, games))
    assert rows(SM.season_stats(spark, out_dir)) == want
    into = os.path.join(out_dir, "compacted")
    with pytest.raises(ValueError):
        SM.add(points, games, out_dir, "a/b")
    SM.compact(spark, out_dir, into)
    assert rows(SM.season_stats(spark, into)) == want
    with pytest.raises(Exception, match="already exists"):  # a batch counts once
        SM.add(spark.createDataFrame(cuts[1], POINTS), games, out_dir, "w1")


def test_schedule_lines_that_do_not_fit(spark, out_dir):
    lines = ['1,Thu,September 4,Team,,Other', '2,Sun,Smarch 1,Team,,Other', 'x,Sun,May 2,Team,,Other',
             '3,Sun,May 3', '4,Sun,May 4,"A, B",,Other', '', ',,,,,', '5,Sun,May 5,Team,,Other,more,yet']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(os.path.join(out_dir, "s"))
    good, bad = RJ.read_schedule(spark, os.path.join(out_dir, "s"), 2014)
    assert sorted((r.week or 0, str(r.game_date), r.team) for r in good.collect()) == [
        (0, "None", None), (1, "2014-09-04", "Team"), (4, "2014-05-04", "A, B")]
    found = {r.line: r[RJ.REASONS] for r in bad.collect()}
    assert found == {lines[1]: ["date"], lines[2]: ["week"], lines[3]: ["fields"], lines[5]: ["fields"],
                     lines[7]: ["fields"]}
    assert {r.reason: r.records for r in RJ.counts(bad).collect()} == {"date": 1, "week": 1, "fields": 3}
    RJ.write(bad, os.path.join(out_dir, "rejects"))
    back = K.read_key_counts(spark, os.path.join(out_dir, "rejects", "counts"), "reason", "records")
    assert {r.reason: r.records for r in back.collect()} == {"date": 1, "week": 1, "fields": 3}
    RJ.at_most(bad, 5)
    with pytest.raises(ValueError):
        RJ.at_most(bad, 4)


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1", "2000"), ("G2", "2000"), (None, "x"), ("3", None), ("G4", "y")],
                               "gid string, seas string")
    good, bad = RJ.games(df)
    assert good.dtypes == [("gid", "bigint"), ("seas", "int")]
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2000), (3, None)]
    assert {r.gid: r[RJ.REASONS] for r in bad.collect()} == {
        "G2": ["gid: no bigint"], None: ["seas: no int"], "G4": ["gid: no bigint", "seas: no int"]}
    whole = RJ.points(spark.createDataFrame([("a", 1, 2, 3, 4)], POINTS))
    assert whole[0].count() == 1 and whole[1].count() == 0
    with pytest.raises(ValueError):
        RJ.split(df.withColumnRenamed("seas", RJ.REASONS), {})
