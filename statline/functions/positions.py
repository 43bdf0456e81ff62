"""Position vocabulary of a fantasy roster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Raw position -> roster position; every other value maps to "".
ROSTER_POSITION = {
    "RB": "RB",
    "QB": "QB",
    "DB": "DEF",
    "DL": "DEF",
    "K": "K",
    "LB": "DEF",
    "OL": "OFF",
    "TE": "TE",
    "WR": "WR",
    "LS": "LS",
}
# Roster positions that are never drafted.
NOT_DRAFTWORTHY = ("OFF", "LS")
# The flex group and the positions that feed it.
FLEX = "WR/TE/RB"
FLEX_MEMBERS = ("WR", "TE", "RB")
# Position groups and how many players of each are kept for roster search.
TOP_K = {"RB": 5, "QB": 5, "WR": 5, "DEF": 5, "K": 3, "TE": 4, "WR/TE/RB": 4}
# Placeholder id of "no player" in the play tables.
NO_PLAYER = "XX-0000"
# ---------------------------------------------------------------------------

GROUPS = ("RB", "QB", "TE", "K", "DEF", "WR", FLEX)


def roster_position(raw: Column | str) -> Column:
    """Translate a raw position (case-sensitive, untrimmed); NULL and unknown -> ""."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    pairs = []
    for src, dst in ROSTER_POSITION.items():
        pairs += [F.lit(src), F.lit(dst)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), F.lit(""))


def draftworthy(pos: Column | str) -> Column:
    """True unless the roster position is OFF or LS ("" is kept)."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return ~pos.isin(*NOT_DRAFTWORTHY)


def slots_of(pos: Column | str) -> Column:
    """Groups a roster position belongs to: its own group, plus flex for WR/TE/RB."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return (
        F.when(pos.isin(*FLEX_MEMBERS), F.array(pos, F.lit(FLEX)))
        .when(pos.isin(*[g for g in GROUPS if g != FLEX]), F.array(pos))
        .otherwise(F.array().cast("array<string>"))
    )


def top_k_bound(slot: Column | str, top_k: dict[str, int] | None = None) -> Column:
    """Per-group k as a literal CASE expression (no join needed)."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    top_k = top_k or TOP_K
    expr = None
    for group, k in top_k.items():
        expr = (F.when(slot == group, F.lit(k)) if expr is None
                else expr.when(slot == group, F.lit(k)))
    return expr.otherwise(F.lit(0))
