"""Prefix doubling over all positions as Spark jobs, row by row.

Every position of every text is a row.  Ranks of strings of ``w`` bytes give
ranks of longer strings: a position's new rank is the rank of the pair (its
rank, the rank at a growing offset), from a sort of all distinct pairs.
Positions whose string is unique keep their rank and are not ranked again.

This is the dealt form of operator 10 to the letter.  It is exact, and it is
kept as a reference for the sparse plan of ``suffix_dedup``: it moves every
position several times in every round, which no budget of a few bytes of
shuffle for a byte of text allows (figures in the README).

Defined cases: a null text is empty; rows are told apart by their number, so
repeated rows are repeats of each other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import stored

FIRST = 7  # bytes of the first key: they and a sign fit a long


def positions(docs: DataFrame) -> DataFrame:
    """row, at, a rank of the first ``FIRST`` bytes there, of every position
    that has so many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("row"))
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off):
                part, at = buf[off[a]:off[b]], off[a:b + 1] - off[a]
                starts = np.flatnonzero(S.window_mask(len(part), at, FIRST))
                key = np.zeros(len(starts), dtype=np.int64)
                for i in range(FIRST):
                    key = key << 8 | part[starts + i]
                row = np.searchsorted(at, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[a + row]), pa.array((starts - at[row]).astype(np.int64)), pa.array(key)],
                    names=["row", "at", "rank"])

    return docs.select("row", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "row long, at long, rank long")


def ranked_again(have: DataFrame, offset: int) -> DataFrame:
    """Ranks of the pairs (rank, rank at the offset) of the positions that have
    both; unique ones are final."""
    in_text = Window.partitionBy("row").orderBy("at")
    pairs = have.withColumn("next", F.lead("rank", offset).over(in_text)).filter("next is not null")
    pairs = pairs.select("row", "at", F.col("rank").alias("first"),
                         F.when(~F.col("final"), F.col("next")).alias("second"), "final")
    kinds = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    # pairs in order: their numbers are ranks
    order = [F.col("first"), F.col("second").asc_nulls_first()]
    ranks = stored(kinds.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.col("first").alias("f"), F.col("second").alias("s"), "n",
        F.monotonically_increasing_id().alias("rank")), "pair_ranks")
    return stored(pairs.join(ranks, (F.col("first") == F.col("f")) & F.col("second").eqNullSafe(F.col("s")))
                  .select("row", "at", "rank", (F.col("n") == 1).alias("final")), "ranks")


def repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """row, at of every string of ``length`` bytes (``FIRST`` at least) that
    starts elsewhere too; ``docs`` has the columns row (a number) and text."""
    have = stored(positions(docs), "ranks")
    alone = have.groupBy("rank").agg((F.count(F.lit(1)) == 1).alias("final"))
    have = stored(have.join(alone, "rank").select("row", "at", "rank", "final"), "ranks")
    width = FIRST
    while width < length:
        offset = min(width, length - width)
        have = ranked_again(have, offset)
        width += offset
    return have.filter(~F.col("final")).select("row", "at")
