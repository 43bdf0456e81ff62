"""Rows of HTML data tables, extracted in Spark from a table of pages.

For every table of class ``data`` of a page: the first row names the team
(text of its first link), the second row is a header and is skipped, and
every later row with exactly six cells becomes an output row of the six cell
texts plus the team.  Rows with another cell count are dropped.

Pages are cut into tags and text runs, and one fold over a page's tokens reads
them as a small state machine: the table being read, those that it is nested
in, and the rows found so far.  It all happens inside the page's row: no
Python, no shuffle, and a page is read by one task as it lies.

What counts:
* a table whose class attribute, quoted in any way, has the class ``data``
  among its classes (``class="data sortable"`` too, ``data-class`` not);
  comments, scripts and styles are no markup
* rows and cells of the table itself: a table nested in a cell is a table of
  its own, and neither its rows nor its text belong to the outer one
* cell text without tags, references decoded, without white space around it
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# What is extracted.
TABLE_CLASS = "data"
CELLS_PER_ROW = 6
# Named character references decoded in cell text ("&amp;" last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
            ("&eacute;", "é"), ("&egrave;", "è"), ("&uuml;", "ü"), ("&ouml;", "ö"),
            ("&auml;", "ä"), ("&ntilde;", "ñ"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"),
            ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&amp;", "&"))
# ---------------------------------------------------------------------------

_NO_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
# Tags that say nothing about tables, rows, cells and links; without them the
# text around them is one run.
_OTHER_TAG = r"(?is)<(?!/?(?:table|tr|td|a)(?![a-z0-9]))[a-z/!][^>]*>"
_TOKEN = r"(?s)</?[a-zA-Z][^>]*>|[^<]+|<"
_CLASS = r"""(?is)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_REFERENCE = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
CELL_COLUMNS = tuple(f"c{i}" for i in range(1, CELLS_PER_ROW + 1))


def _character(ref: Column) -> Column:
    """The character of a numeric reference; one that names none stays."""
    digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("int")).otherwise(
        digits.try_cast("int"))
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)


def cell_text(c: Column) -> Column:
    """Text with its character references decoded, trimmed."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)))
    out = F.aggregate(refs, c, lambda text, ref: F.replace(text, ref, _character(ref)))
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.regexp_replace(out, r"^[\s\u00A0]+|[\s\u00A0]+$", "")


# The table being read: where it began, whether it is of the class, its row
# number, cells so far, whether a cell and the first link are open, links in the
# row, and its team.
_TABLE = ("struct<at: int, data: boolean, row: int, cells: array<string>, in_cell: boolean, "
          "links: int, in_link: boolean, team: string>")
_ROW = "struct<at: int, row: int, cells: array<string>, team: string>"


def _with(table: Column, **changes: Column) -> Column:
    """The table with some fields changed."""
    names = ("at", "data", "row", "cells", "in_cell", "links", "in_link", "team")
    return F.struct(*[changes.get(n, table[n]).alias(n) for n in names])


def _finished(table: Column) -> Column:
    """The table's last row as an array: empty unless it is to be kept."""
    full = table["data"] & (table["row"] >= 3) & (F.size(table["cells"]) == CELLS_PER_ROW)
    row = F.struct(table["at"].alias("at"), table["row"].alias("row"), table["cells"].alias("cells"),
                   table["team"].alias("team"))
    return F.when(F.coalesce(full, F.lit(False)), F.array(row)).otherwise(
        F.array().cast(f"array<{_ROW}>"))


def _step(state: Column, token: Column) -> Column:
    """The state after one token."""
    tag, now = token["tag"], state["now"]
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast(_TABLE)
    in_row = now["row"] > 0
    opened = F.struct(
        token["at"].alias("at"), token["data"].alias("data"), F.lit(0).alias("row"),
        F.array().cast("array<string>").alias("cells"), no.alias("in_cell"), F.lit(0).alias("links"),
        no.alias("in_link"), F.lit(None).cast("string").alias("team"))
    # a text run belongs to the open cell, and to the team in the first row's first link
    last = F.size(now["cells"])
    cells = F.when(now["in_cell"], F.concat(
        F.slice(now["cells"], F.lit(1), last - 1),
        F.array(F.concat(F.element_at(now["cells"], -1), token["text"])))).otherwise(now["cells"])
    team = F.when((now["row"] == 1) & (now["links"] == 1) & now["in_link"], F.concat(
        F.coalesce(now["team"], F.lit("")), token["text"])).otherwise(now["team"])
    read = (F.when(tag == "table", opened)
            .when(tag == "/table", F.try_element_at(state["outer"], F.lit(-1)))
            .when(now.isNull(), none)
            .when(tag == "tr", _with(now, row=now["row"] + 1, cells=F.array().cast("array<string>"),
                                     in_cell=no, links=F.lit(0), in_link=no))
            .when(~in_row, now)
            .when(tag == "td", _with(now, cells=F.concat(now["cells"], F.array(F.lit(""))), in_cell=yes))
            .when(tag == "/td", _with(now, in_cell=no))
            .when(tag == "/tr", _with(now, in_cell=no, in_link=no))
            .when(tag == "a", _with(now, links=now["links"] + 1, in_link=yes))
            .when(tag == "/a", _with(now, in_link=no))
            .when(tag == "", _with(now, cells=cells, team=team))
            .otherwise(now))
    outer = (F.when((tag == "table") & now.isNotNull(), F.concat(state["outer"], F.array(now)))
             .when(tag == "/table", F.slice(state["outer"], F.lit(1), F.greatest(
                 F.size(state["outer"]) - 1, F.lit(0))))
             .otherwise(state["outer"]))
    rows = F.when(tag.isin("tr", "/table"), F.concat(state["rows"], _finished(now))).otherwise(state["rows"])
    begun = F.when((tag == "tr") & now["data"] & (now["row"] == 0), F.concat(
        state["begun"], F.array(now["at"]))).otherwise(state["begun"])
    return F.struct(read.alias("now"), outer.alias("outer"), rows.alias("rows"), begun.alias("begun"))


def _found(state: Column) -> Column:
    """The rows at a page's end, with those of tables that it leaves open."""
    return F.struct(
        F.flatten(F.concat(F.array(state["rows"]), F.transform(
            F.concat(state["outer"], F.array(state["now"])), _finished))).alias("rows"),
        F.array_sort(state["begun"]).alias("begun"))


def _tokens(html: Column) -> Column:
    """Tags (lower-case name, "/" first if it ends) and text runs (tag "")."""
    classes = (lambda text: F.split(F.regexp_replace(F.regexp_extract(text, _CLASS, 1), "[\"']", " "), r"\s+"))
    texts = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    named = F.transform(texts, lambda text: F.struct(
        text.alias("text"), F.lower(F.regexp_extract(text, r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag")))
    return F.transform(named, lambda token, at: F.struct(
        at.alias("at"), token["tag"].alias("tag"),
        F.when(token["tag"] == "table", F.array_contains(classes(token["text"]), TABLE_CLASS)).alias("data"),
        token["text"].alias("text")))


@lru_cache(maxsize=8)
def _expressions(html_col: str, gateway: object) -> tuple[Column, list[Column]]:
    """The fold over a page, and the output columns of a found row.  They do not
    depend on the table, and building them takes a thousand calls to the JVM:
    they are built once for each JVM (``gateway``)."""
    plain = F.regexp_replace(F.col(html_col), _NO_MARKUP, "")
    tables = F.regexp_extract(plain, r"(?is)<table(?![a-z0-9]).*", 0)
    html = F.regexp_replace(tables, _OTHER_TAG, "")
    start = F.struct(
        F.lit(None).cast(_TABLE).alias("now"), F.array().cast(f"array<{_TABLE}>").alias("outer"),
        F.array().cast(f"array<{_ROW}>").alias("rows"), F.array().cast("array<int>").alias("begun"))
    found = F.aggregate(_tokens(html), start, _step, _found)
    return found, [
        (F.array_position("begun", F.col("_r.at")) - 1).cast("int").alias("table_no"),
        (F.col("_r.row") - 3).cast("int").alias("row_no"),
        *[cell_text(F.col("_r.cells")[i]).alias(c) for i, c in enumerate(CELL_COLUMNS)],
        F.nullif(cell_text(F.col("_r.team")), F.lit("")).alias("team")]


def table_rows(pages: DataFrame, html_col: str = "html",
               keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns + (table_no, row_no, c1..c6, team)."""
    found, columns = _expressions(html_col, getattr(SparkContext, "_gateway", None))
    rows = (pages.filter(F.col(html_col).rlike("(?i)<table"))
            .select(F.struct(*keep).alias("_keep"), found.alias("_found"))
            .select("_keep", "_found.begun", F.explode("_found.rows").alias("_r")))
    return rows.select("_keep.*", *columns)
