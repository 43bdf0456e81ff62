"""Enumeration of every nine-slot roster built from the top players.

Slots, in the reference's order: QB, RB, RB, WR, WR, K, DEF, TE, flex.  The
top players (at most k per group, 31 rows in all by default) are gathered into
one row of seven small arrays, and the slots are exploded one after the other
with the duplicate-player predicates as filters, so invalid rosters are pruned
as soon as both slots are bound.  It is one lazy plan without a join: nothing
runs before the result is asked for.

The product is the feature itself: at most 5·5·5·5·5·3·5·4·4 = 750,000 rows
whatever the size of the data.  A larger ``top_k`` is accepted up to
``MAX_ROSTERS`` combinations and refused beyond; it is never cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.functions.positions import FLEX, TOP_K, top_k_bound

# (output column, position group) in the reference's roster order
SLOTS = (("qb", "QB"), ("rb1", "RB"), ("rb2", "RB"), ("wr1", "WR"), ("wr2", "WR"),
         ("k", "K"), ("def", "DEF"), ("te", "TE"), ("flex", FLEX))
OUTPUT = ("qb", "rb1", "rb2", "wr1", "wr2", "te", "k", "flex", "def")
SPREAD_AFTER = "wr1"
MAX_ROSTERS = 10_000_000


def _distinct(a: str, b: str, unordered: bool) -> Column:
    return F.col(a) < F.col(b) if unordered else F.col(a) != F.col(b)


def max_rosters(top_k: dict[str, int] | None = None) -> int:
    """Upper bound of the output size: the product of the slot sizes."""
    top_k = top_k or TOP_K
    n = 1
    for _, group in SLOTS:
        n *= top_k[group]
    return n


def rosters(top: DataFrame, strict: bool = True, unordered: bool = False,
            top_k: dict[str, int] | None = None) -> DataFrame:
    """(qb, rb1, rb2, wr1, wr2, te, k, flex, def, meanTotal, varianceTotal).

    ``strict=False`` applies only the reference's checks (rb1≠rb2, wr1≠wr2,
    flex ≠ rb1, rb2, wr1, wr2); ``strict=True`` also requires te ≠ flex.
    ``unordered=True`` keeps one order of each RB pair and WR pair.
    Totals add the nine target-year means (and variances) in slot order.
    """
    bound = max_rosters(top_k)
    if bound > MAX_ROSTERS:
        raise ValueError(f"top_k allows {bound} rosters; the limit is {MAX_ROSTERS}")
    # the bound holds whatever the input: only ranks within each group's k
    player = F.struct("player_id", "mean", "variance")
    names = sorted({group for _, group in SLOTS})
    out = (top.filter(F.col("rank") <= top_k_bound("slot", top_k))
           .agg(*[F.collect_list(F.when(F.col("slot") == g, player)).alias(f"_g{i}")
                  for i, g in enumerate(names)]))
    conds = {
        "rb2": _distinct("rb1", "rb2", unordered),
        "wr2": _distinct("wr1", "wr2", unordered),
        "flex": reduce(lambda a, b: a & b, [F.col(s) != F.col("flex") for s in
                                            ("rb1", "rb2", "wr1", "wr2")
                                            + (("te",) if strict else ())]),
    }
    for name, group in SLOTS:
        out = (out.withColumn("_p", F.explode(f"_g{names.index(group)}"))
               .withColumns({name: F.col("_p.player_id"), f"_m_{name}": F.col("_p.mean"),
                             f"_v_{name}": F.col("_p.variance")}).drop("_p"))
        if name in conds:
            out = out.filter(conds[name])
        if name == SPREAD_AFTER:
            # few partial rosters so far: spread them round-robin, so that the
            # rest of the product does not run in the single task of the arrays
            out = out.repartition(int(top.sparkSession.conf.get(
                "spark.sql.shuffle.partitions", "8")))
    mean_total = reduce(lambda a, b: a + b, [F.col(f"_m_{n}") for n, _ in SLOTS])
    var_total = reduce(lambda a, b: a + b, [F.col(f"_v_{n}") for n, _ in SLOTS])
    return out.select(*OUTPUT, mean_total.alias("meanTotal"), var_total.alias("varianceTotal"))
