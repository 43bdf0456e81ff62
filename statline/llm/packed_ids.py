"""Token ids in fixed-width packed blocks.

File format: a Parquet folder, one row per block of whole documents, in
ascending doc_id order:

* ``shard``  number of the writing task; shards are consecutive doc_id ranges
* ``start``  ids of the shard before this block (the block's offset)
* ``width``  bits of an id: as few as hold the largest id of the vocabulary
* ``doc_ids``, ``lengths``  the block's documents and their numbers of ids
* ``packed`` the ids, ``width`` bits each, lowest bit first, no gaps

A reader finds a document by its shard and offset and unpacks a block, or any
part of it, with numpy (``unpack(data, width, first, count)``).

Parquet rather than bare files: Spark reads and writes it in every store, and
a lost task is written again without leaving half a block.

Defined cases: a null or empty text has only the end id; a null doc_id comes
first; rows that repeat a doc_id stand next to each other, ordered by text;
an empty table gives an empty folder and no rows; other columns are ignored.
The literal of a special token in a text becomes its id, as the library's call
has it (add_special_tokens=False only adds none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm import units
from statline.llm.units import UnitEncoder

END_ID = 0
BLOCK_IDS = 1 << 17
SCHEMA = ("shard int, start long, width int, doc_ids array<long>, lengths array<int>, "
          "packed binary")


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit packing; whole-byte widths are plain integers."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from id ``first`` on, without touching the rest."""
    total = len(data) * 8 // width
    count = total - first if count is None else count
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    begin, end = first * width, (first + count) * width
    raw = np.frombuffer(data, np.uint8)[begin // 8:(end + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[begin % 8:begin % 8 + count * width]
    return bits.reshape(count, width).astype(np.uint32) @ (
        np.uint32(1) << np.arange(width, dtype=np.uint32))


class LibraryEncoder:
    """The tokenizers library on distinct parts of texts (see ``units``)."""

    def __init__(self, path: str, **cache: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = width_of(size)
        bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(size)])
        self.units = UnitEncoder(self.encode_text, self.encode_parts, bytes_of, **cache)

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.encode_parts([text])[0], dtype=np.uint32)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(path)
        shard, start = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            own = pa.concat_arrays([h[0] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([lib.width], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                 pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()),
                                          pa.array(lengths.astype(np.int32))),
                 pa.array([pack(ids, lib.width)], pa.binary())],
                names=["shard", "start", "width", "doc_ids", "lengths", "packed"])

        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off, units.CHUNK):
                ids, at = lib.units.texts(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                ids = np.insert(ids, at[1:], end_id)
                lengths = np.diff(at) + 1
                ends, row, done = np.cumsum(lengths), 0, 0
                while row < b - a:
                    more = int(np.searchsorted(ends, done + block_ids - size)) + 1
                    more = min(more, b - a)
                    held.append((batch.column("doc_id").slice(a + row, more - row),
                                 ids[done:ends[more - 1]], lengths[row:more]))
                    size += int(ends[more - 1]) - done
                    row, done = more, int(ends[more - 1])
                    if size >= block_ids:
                        yield block()
                        start, size, held = start + size, 0, []
        if held:
            yield block()
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
          block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text, appends ``end_id`` and writes the blocks."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    (base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_blocks(tokenizer, end_id, block_ids), SCHEMA)
     .write.option("compression", "zstd").parquet(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks, ``first`` being the ids of all documents before a block.

    Blocks carry their offset in the shard, so only one total per shard is
    summed up; shards are as many as the writer's tasks."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    totals = blocks.select("shard", (F.col("start") + F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end"))
    totals = totals.groupBy("shard").agg(F.max("end").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("first", F.col("base") + F.col("start"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = unpack(batch.column("packed")[r].as_py(), batch.column("width")[r].as_py())
                own = batch.column("doc_ids")[r].values
                lengths = np.asarray(batch.column("lengths")[r].values).astype(np.int64)
                off = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids[:off[-1]].astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in
                       zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(off[:-1] + batch.column("first")[r].as_py()),
                     pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, folder).select("width", "doc_ids", "lengths", "packed", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
