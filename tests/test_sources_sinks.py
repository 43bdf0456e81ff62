"""CSV schedule, HTML table extraction and the sinks."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from statline.plans import fixtures as FX
from statline.sources import html_tables as H
from statline.sources import schedule as SCH
from statline.sources import sinks as K

SCHEDULE_LINES = [
    "1,Thu,September 4,Seattle Seahawks,,Green Bay Packers",
    "1,Sun,September 7,Denver Broncos,,Indianapolis Colts",
    "17,Sun,December 28,New York Jets,,Miami Dolphins",
    "18,Sun,Smarch 40,Nobody,,Nobody",
]


def test_schedule_csv(spark, out_dir):
    path = os.path.join(out_dir, "2014_game_schedule.csv")
    with open(path, "w") as f:
        f.write("\n".join(SCHEDULE_LINES) + "\n")
    rows = SCH.read_schedule(spark, path, year=2014).collect()
    assert len(rows) == 4 and rows[3].game_date is None
    assert rows[0].week == 1 and rows[0].weekday == "Thu"
    assert str(rows[0].game_date) == "2014-09-04" and rows[2].week == 17
    assert rows[0].team == "Seattle Seahawks" and rows[0].opponent == "Green Bay Packers"


PAGE = """<html><body>
<table class="nav"><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr></table>
<table class="data">
 <tr class="title"><td colspan="6"><a href="/t/1">Team &amp; One</a></td></tr>
 <tr><th>Date</th><th>Pos</th><th>Player</th><th>Injury</th><th>Status</th><th>Returns</th></tr>
 <tr><td>Sep 1</td><td>WR</td><td><a href="/p/1">A. Player</a></td><td>Knee</td>
     <td>Out</td><td>&lt;1 week&gt;</td></tr>
 <tr><td>only</td><td>five</td><td>cells</td><td>in</td><td>row</td></tr>
 <tr><td>Sep 2</td><td>QB</td><td>B</td><td>Ankle</td><td>Questionable</td><td>TBD</td></tr>
</table>
<TABLE CLASS="data"><tr><td>no link title</td></tr><tr><td>h</td></tr>
<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr></TABLE>
<table class="data"><tr><td><a>only one row</a></td></tr></table>
</body></html>"""


def test_html_table_rows(spark):
    pages = spark.createDataFrame([(7, "u", PAGE)], "page_id long, url string, html string")
    rows = H.table_rows(pages).orderBy("table_no", "row_no").collect()
    assert [(r.c1, r.c3, r.c6, r.team) for r in rows] == [
        ("Sep 1", "A. Player", "<1 week>", "Team & One"),
        ("Sep 2", "B", "TBD", "Team & One"),
        ("1", "3", "6", None),
    ]


def test_rendered_pages_are_bounded(spark):
    d = "/root/testdata/sf0.01"
    pages = FX.render_supplier_pages(spark.read.parquet(f"{d}/supplier.parquet"),
                                    spark.read.parquet(f"{d}/nation.parquet"),
                                    spark.read.parquet(f"{d}/region.parquet"))
    n_rows = pages.select(F.max(F.size(F.split("html", "<tr>")))).first()[0]
    assert n_rows <= FX.ROWS_PER_PAGE + 3 + 2


def test_ctas_modes(spark, out_dir):
    df = spark.range(3)
    path = os.path.join(out_dir, "t")
    K.create_table_as(df, path)
    with pytest.raises(AnalysisException):
        K.create_table_as(df, path)
    K.create_table_as(spark.range(10), path, if_not_exists=True)  # skipped
    assert spark.read.parquet(path).count() == 3


def test_key_counts_roundtrip_with_empty_key(spark, out_dir):
    counts = spark.createDataFrame([("", 4), ("WR/TE/RB", 2)], "position string, players long")
    path = os.path.join(out_dir, "c")
    K.write_key_counts(counts, "position", "players", path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == [",4", "WR/TE/RB,2"]
    back = sorted(tuple(r) for r in K.read_key_counts(spark, path, "position", "players")
                  .collect())
    assert back == [("", 4), ("WR/TE/RB", 2)]


def test_position_groups_partitioned_json(spark, out_dir):
    from statline.operators import stats as ST
    stats = spark.createDataFrame(
        [(p, 2000, 1, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 3.0, 0.0) for p in ("a", "b")],
        "player_id string, season int, games long, passing_mean double, "
        "passing_variance double, rushing_mean double, rushing_variance double, "
        "receiving_mean double, receiving_variance double, total_mean double, "
        "total_variance double")
    yearly = ST.player_yearly_stats(stats)
    groups = yearly.select(F.explode(F.array(F.lit("WR"), F.lit("WR/TE/RB"))).alias("slot"),
                           F.col("playerId").alias("player_id"), "statsByYear")
    path = os.path.join(out_dir, "g")
    K.write_position_groups(groups, path)
    back = K.read_json_lines(spark, path, K.PLAYER_YEARLY_STATS)
    assert sorted(r.slot for r in back.select("slot").distinct().collect()) == ["WR", "WR/TE/RB"]
    assert back.filter("slot = 'WR/TE/RB'").count() == 2


def test_record_schemas_and_json_order(spark, out_dir):
    import json

    from statline.operators import stats as ST
    stats = spark.createDataFrame(
        [("a", 2000, 2, 1.0, 0.5, 2.0, 0.0, 3.0, 1.0, 6.0, 1.5)],
        "player_id string, season int, games long, passing_mean double, "
        "passing_variance double, rushing_mean double, rushing_variance double, "
        "receiving_mean double, receiving_variance double, total_mean double, "
        "total_variance double")
    yearly = ST.player_yearly_stats(stats)
    pq = os.path.join(out_dir, "yearly")
    K.write_player_yearly_stats(yearly, pq)
    back = spark.read.parquet(pq)
    assert [f.name for f in back.schema.fields] == K.PLAYER_YEARLY_STATS.fieldNames()
    elem = back.schema["statsByYear"].dataType.elementType
    assert elem.fieldNames() == K.STATS_BY_YEAR.fieldNames()
    with pytest.raises(AnalysisException):
        K.write_player_yearly_stats(yearly, pq)
    js = os.path.join(out_dir, "yearly-json")
    K.write_json_lines(yearly, js)
    line = spark.read.text(js).first().value
    rec = json.loads(line)
    assert list(rec) == ["playerId", "statsByYear"]
    assert list(rec["statsByYear"][0]) == K.STATS_BY_YEAR.fieldNames()
    assert rec["statsByYear"][0]["receivingStats"] == {"mean": 3.0, "variance": 1.0}


def test_extraction_inside_real_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    table = ('<table class="data"><tr><td><a href="/t">Team Z</a></td></tr>'
             "<tr><td>h</td></tr>"
             "<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr>"
             "<tr><td>a</td><td>b</td><td>c</td><td>d</td><td>e</td><td>f</td></tr></table>")
    injected = pages.withColumn("html", F.concat("html", F.lit(table)))
    rows = H.table_rows(injected)
    n_pages = pages.count()
    assert H.table_rows(pages).count() == 0          # the real pages hold no data tables
    assert rows.count() == 2 * n_pages
    per_page = rows.groupBy("page_id").count().filter("count <> 2").count()
    assert per_page == 0 and rows.filter("team <> 'Team Z'").count() == 0


def _rows(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [tuple(r)[3:] for r in H.table_rows(pages).orderBy("table_no", "row_no").collect()]


HEAD = "<tr><td><a>T</a></td></tr><tr><td>h</td></tr>"
SIX = "<tr>" + "".join(f"<td>{c}</td>" for c in "abcdef") + "</tr>"
ROW = [("a", "b", "c", "d", "e", "f", "T")]


@pytest.mark.parametrize("tag", ['<table class="data">', "<table class='data'>", "<table class=data>",
                                 '<TABLE ID=x CLASS = "data sortable" >', "<table\nclass=data\n>"])
def test_any_spelling_of_the_class(spark, tag):
    assert _rows(spark, f"<p>{tag}{HEAD}{SIX}</table>") == ROW


@pytest.mark.parametrize("html", ['<table data-class="data">%s</table>', '<table class="database">%s</table>',
                                  '<!-- <table class="data">%s</table> -->', "<p>%s",
                                  '<script>"<table class=data>%s</table>"</script>'])
def test_what_is_no_data_table(spark, html):
    assert _rows(spark, html % (HEAD + SIX)) == []


def test_nested_table_is_its_own(spark):
    inner = "<table class=data>" + HEAD.replace("T", "U") + SIX + "</table>"
    outer = f'<table class="data">{HEAD}{SIX[:-len("</td></tr>")]} {inner}</td></tr>{SIX}</table>'
    assert _rows(spark, outer) == [*ROW, *ROW, ("a", "b", "c", "d", "e", "f", "U")]


def test_text_is_trimmed_and_decoded(spark):
    row = ("<tr><td> Knee \n</td><td>e&#8217;s</td><td>&eacute;&#xE9;</td><td>&amp;lt;&nbsp;</td>"
           "<td>a <b>b</b> c</td><td>&#99999999;&#xD800; &#x1F600;</td></tr>")
    assert _rows(spark, f"<table class=data>{HEAD}{row}</table>") == [
        ("Knee", "e\u2019s", "éé", "&lt;", "a b c", "&#99999999;&#xD800; \U0001F600", "T")]


def test_null_and_comma_in_rendered_lines(spark, out_dir):
    df = spark.createDataFrame([("1", "Thu", "September 4", "A, B", None),
                                ("2", "Sun", "September 7", None, 'say "C"')],
                               "w string, d string, t string, a string, b string")
    lines = df.select(F.lit(2014).alias("season"), FX.csv_line(
        F.col("w"), F.col("d"), F.col("t"), F.col("a"), F.lit(""), F.col("b")).alias("value"))
    path = os.path.join(out_dir, "s")
    SCH.write_schedule(lines, path)
    got = [(r.week, r.team, r.opponent) for r in SCH.read_schedule(spark, path).orderBy("week").collect()]
    assert got == [(1, "A, B", None), (2, None, 'say "C"')]


def test_key_counts_with_nulls_and_commas(spark, out_dir):
    df = spark.createDataFrame([(None, 3), ("a,b", 4), ("c", None)], "k string, n long")
    path = os.path.join(out_dir, "kc")
    K.write_key_counts(df, "k", "n", path)
    got = sorted(map(tuple, K.read_key_counts(spark, path, "k", "n").collect()))
    assert got == [("", 3), ("a,b", 4), ("c", None)]


def test_a_rewritten_table_is_read_with_its_new_columns(spark, out_dir):
    from statline.sources.tables import table
    path = os.path.join(out_dir, "t.parquet")
    spark.range(2).write.parquet(path)
    assert table(spark, out_dir, "t").columns == ["id"]
    spark.range(2).withColumn("x", F.lit(1)).write.mode("overwrite").parquet(path)
    assert table(spark, out_dir, "t").columns == ["id", "x"]
