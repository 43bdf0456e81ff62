"""Test inputs rendered from the shared tables: schedule lines and HTML pages
for the schedule source and the HTML extractor.  Not part of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*columns: Column) -> Column:
    """One CSV line: every NULL is an empty field, texts are quoted if needed."""
    return F.to_csv(F.struct(*[F.coalesce(c, F.lit("")).alias(f"f{i}")
                               for i, c in enumerate(columns)]), {"emptyValue": ""})


def _schedule_lines(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    games = (orders.join(customer, orders.o_custkey == customer.c_custkey)
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    week = F.call_function("div", F.dayofyear(d) - 1, F.lit(7)) + 1
    return games.select(
        "o_orderkey", F.date_format(d, "MMMM d").alias("day"), F.year(d).cast("int").alias("season"),
        csv_line(week.cast("string"), F.date_format(d, "EEE"), F.date_format(d, "MMMM d"),
                 F.col("c_name"), F.lit(""), F.col("n_name")).alias("value"))


def render_schedule(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Schedule lines derived from orders, in the file's layout:
    (season, value) with value = ``week,Wkd,Month d,team,,opponent``.

    One game per order: the customer is the team, its nation the opponent.
    """
    return _schedule_lines(orders, customer, nation).select("season", "value")


def render_spoiled_schedule(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The schedule lines, some spoiled by the last digit of the order: a field
    too many (3), a week that is no number (5), a day that is none (7), the
    last two at once (9)."""
    digit, line = F.col("o_orderkey") % 10, F.col("value")
    no_day = F.replace(line, F.col("day"), F.lit("Smarch 13"))
    return _schedule_lines(orders, customer, nation).select(
        "season", F.when(digit == 3, F.concat(line, F.lit(",late"))).when(
            digit == 5, F.concat(F.lit("w"), line)).when(digit == 7, no_day).when(
            digit == 9, F.concat(F.lit("w"), no_day)).otherwise(line).alias("value"))


def spoiled_games(orders: DataFrame) -> DataFrame:
    """Games as texts (gid, seas), some of them no numbers."""
    key = F.col("o_orderkey")
    return orders.select(
        F.when(key % 50 == 1, F.concat(F.lit("G"), key.cast("string"))).when(
            key % 50 != 2, key.cast("string")).alias("gid"),
        F.when(key % 70 == 1, F.lit("spring")).otherwise(
            F.year("o_orderdate").cast("string")).alias("seas"))


ROWS_PER_PAGE = 50


def _td(c: Column) -> Column:
    return F.concat(F.lit("<td>"), c, F.lit("</td>"))


def render_supplier_pages(supplier: DataFrame, nation: DataFrame,
                          region: DataFrame) -> DataFrame:
    """(page_id, url, html): one page per nation and block of 50 supplier keys.

    Each page has a navigation table (not class "data") and a data table:
    title row with the nation link, header row, then one six-cell row per
    supplier with a non-negative balance and a seven-cell row otherwise.
    A page holds at most 50 suppliers, however many suppliers a nation has.
    """
    s = (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    cells = [F.col("s_suppkey").cast("string"),
             F.concat(F.lit("<b>"), F.col("s_name"), F.lit("</b>")),
             F.col("n_name"),
             F.floor("s_acctbal").cast("bigint").cast("string"),
             F.col("r_name"),
             F.lit("good &amp; active")]
    tr = F.concat(F.lit("<tr>"), *[_td(c) for c in cells],
                  F.when(F.col("s_acctbal") < 0, _td(F.lit("overdrawn"))).otherwise(F.lit("")),
                  F.lit("</tr>"))
    block = F.call_function("div", F.col("s_suppkey"), F.lit(ROWS_PER_PAGE))
    per_page = s.groupBy("n_nationkey", "n_name", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", tr.alias("tr")))).alias("rows"))
    header = "".join(f"<td>{h}</td>" for h in ("id", "name", "nation", "balance", "region",
                                               "status"))
    html = F.concat(
        F.lit('<html><body><table class="nav"><tr><td>a</td><td>b</td><td>c</td><td>d</td>'
              '<td>e</td><td>f</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td>'
              '<td>5</td><td>6</td></tr></table>\n<table class="data">\n'
              '<tr class="title"><td colspan="6"><a href="/nation/'),
        F.col("n_nationkey").cast("string"), F.lit('">'), F.col("n_name"),
        F.lit(f'</a></td></tr>\n<tr class="header">{header}</tr>\n'),
        F.array_join(F.transform("rows", lambda r: r["tr"]), "\n"),
        F.lit("\n</table></body></html>"))
    page_id = F.col("n_nationkey").cast("bigint") * F.lit(1_000_000_000) + F.col("block")
    return per_page.select(
        page_id.alias("page_id"),
        F.concat(F.lit("https://example.org/suppliers/"), F.col("n_nationkey").cast("string"),
                 F.lit("/"), F.col("block").cast("string")).alias("url"),
        html.alias("html"))


# Data tables appended to every page of ``pages``, in all the spellings that a
# reader must see (first four) or must not see (last three).  ``{id}`` is the
# page's id.
_HEAD = '<tr><td><a href="/t">Team &amp; {id}</a> <a>x</a></td></tr><tr><td>h</td></tr>'
_SIX = "<tr><td> {id}</td><td>{tag}</td><td><b>c</b></td><td>d&#8217;s</td><td>&#xe9;</td><td>f </td></tr>"
APPENDED = (
    ("double", '<table id="a" class="data">', _HEAD + _SIX),
    ("single", "<TABLE border=0 class='wide data'\n>", _HEAD + _SIX + "<tr><td>1</td></tr>"),
    ("bare", "<table class=data>", _HEAD + _SIX),
    ("nested", '<table class="data">', _HEAD
     + "<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td><table><tr><td>in</td></tr>"
       "</table> 6</td></tr>" + _SIX),
    ("dashed", '<table data-class="data">', _HEAD + _SIX),
    ("other", '<table class="database">', _HEAD + _SIX),
    ("comment", '<!-- <table class="data">', _HEAD + _SIX),
)


def pages_with_tables(pages: DataFrame) -> DataFrame:
    """``pages`` with the tables of ``APPENDED`` at the end of each page."""
    parts = [opening + body.replace("{tag}", kind) + "</table>" + (" -->" if kind == "comment" else "")
             for kind, opening, body in APPENDED]
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.replace(
        F.lit("".join(parts)), F.lit("{id}"), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
