"""Top players of every position group, in one window job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statline.functions.positions import TOP_K, top_k_bound


def top_players(groups: DataFrame, best: bool = True,
                top_k: dict[str, int] | None = None) -> DataFrame:
    """(slot, rank, player_id, mean, variance), k per group from ``top_k``.

    ``best=True`` keeps the highest target-year means; ``best=False`` keeps
    the lowest, which is what the reference's ascending ordering returns.
    Ties break on player id.  The literal bound max(k) lets Catalyst insert a
    partial ``WindowGroupLimit`` before the shuffle, so each map task sends at
    most max(k) rows per group however large the group is.
    """
    top_k = top_k or TOP_K
    order = F.desc("mean") if best else F.asc("mean")
    w = Window.partitionBy("slot").orderBy(order, F.asc("player_id"))
    ranked = groups.select("slot", "player_id", "mean", "variance",
                           F.row_number().over(w).alias("rank"))
    return (ranked.filter(F.col("rank") <= max(top_k.values()))
            .filter(F.col("rank") <= top_k_bound("slot", top_k))
            .select("slot", "rank", "player_id", "mean", "variance"))
