"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots, for good.  The bytes of
each slot are summed, and a small versioned table maps slots to shards; a
rebalancing edits that table, moving as few slots as it can, and never
rehashes a record.  Reading a record's shard is a look-up in a map of
``SLOTS`` rows.

All work on records is DataFrame expressions: a hash, an aggregation to at most
``SLOTS`` rows, and a join with the map, which is broadcast because ``SLOTS``
bounds it.  The map itself is computed on the driver from that bounded table.

The law is ``bytes``: sizes of the shards are near equal (slots are dealt out
largest first to the least filled shard, so shards differ by less than the
largest slot).

Equal texts are a group that may hold a third of all rows; under this law it is
spread like any other rows (the slot is a hash of id and text), since a shard
that kept a group together could not have its share of the bytes.

Defined cases: a null text has no bytes; a null doc_id is hashed like any other
value; equal rows share a slot and have neighbouring places; an empty table
gives no rows and a map of empty slots; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
SHARDS = 40
RECORD_BYTES = 16
_MAP = "version int, vslot int, shard int, bytes long, n long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used slot: at most ``SLOTS`` entries."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {r.vslot: (r.bytes, r.n) for r in sums.collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of every slot: largest slots first, each to the least filled
    shard (then the one with the fewest slots)."""
    out = [0] * slots
    heap = [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, (0, 0))[0], v)):
        total, count, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + sizes.get(slot, (0, 0))[0], count + 1, shard))
    return out


def rebalanced(old: list[int], sizes: dict[int, tuple[int, int]], shards: int,
               tolerance: float = 0.02) -> list[int]:
    """An edit of the map for new sizes or a new number of shards: slots leave
    removed shards, then move from the fullest to the emptiest shard while that
    lessens the spread and it exceeds ``tolerance`` of the mean.  All other
    slots stay."""
    out = list(old)
    size = [sizes.get(v, (0, 0))[0] for v in range(len(out))]
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for v, s in enumerate(out):
        if s < shards:
            total[s] += size[v]
            held[s].append(v)
        else:
            homeless.append(v)
    for v in sorted(homeless, key=lambda v: (-size[v], v)):
        s = min(range(shards), key=lambda s: (total[s], s))
        out[v] = s
        total[s] += size[v]
        held[s].append(v)
    for x in held:
        x.sort(key=lambda v: (size[v], v))
    mean = sum(total) / shards
    for _ in range(len(out)):
        full = max(range(shards), key=lambda s: (total[s], -s))
        free = min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[free]
        fits = [v for v in held[full] if 0 < size[v] < gap]
        if gap <= tolerance * mean or not fits:
            break
        v = min(fits, key=lambda v: (abs(gap / 2 - size[v]), v))
        out[v] = free
        held[full].remove(v)
        held[free].append(v)
        total[full] -= size[v]
        total[free] += size[v]
    return out


def save_map(spark: SparkSession, folder: str, version: int, shard_of: list[int],
             sizes: dict[int, tuple[int, int]]) -> None:
    """Adds a version of the map; earlier versions stay readable."""
    rows = [[version, v, s, *sizes.get(v, (0, 0))] for v, s in enumerate(shard_of)]
    text = json.dumps([dict(zip(("version", "vslot", "shard", "bytes", "n"), r, strict=True))
                       for r in rows])
    (spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{_sql(_MAP)}>>")).alias("m"))
     .select("m.*").coalesce(1).write.mode("append").partitionBy("version").parquet(folder))


def _sql(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in ddl.split(", ")))


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map (the newest if none is named)."""
    stored = spark.read.schema(_MAP).parquet(folder)
    if version is None:
        newest = stored.agg(F.max("version").alias("newest"))
        return stored.join(F.broadcast(newest), F.col("version") == F.col("newest")).drop("newest")
    return stored.filter(F.col("version") == version)


def placed(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Rows with their shard and ``slot``, their gapless place in the shard.

    A place is the number of rows in lower virtual slots of the shard, which
    the map knows, plus the place in the own virtual slot: thousands of small
    groups instead of one per shard."""
    lower = (Window.partitionBy("shard").orderBy("vslot")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = shard_map.select(
        "vslot", "shard", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("place", F.row_number().over(own) - F.lit(1))
            .join(F.broadcast(offsets), "vslot")
            .withColumn("slot", (F.col("before") + F.col("place")).cast("long")))


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the virtual
    slot of every row; the map is stored in ``folder`` as version 1."""
    spark = docs.sparkSession
    rows = records(docs, slots)
    sizes = slot_sizes(rows)
    save_map(spark, folder, 1, first_map(sizes, shards, slots), sizes)
    return placed(rows, load_map(spark, folder, 1)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")
