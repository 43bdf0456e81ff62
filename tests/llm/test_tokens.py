"""Byte-level BPE and packed ids against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from statline.llm import byte_bpe, packed_ids, units
from statline.llm import sequences as S
from statline.session import scratch_path

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", " ", "　", "'s", "'ll", "1", "23",
          "!", "?!", ".", ",", " ", "ß", "x" * 30, "\x1c", "\x85", "👍", "<|endoftext|>",
          "▁", "​", "\x00", "don't", " the", "word", ".\n", "\n\n", "\r\n"]


def awkward(seed: int, n: int) -> list:
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(n)] \
        + [None, "", "a" * 4000, " " * 2000, "日本" * 500]


def library():
    return Tokenizer.from_file(JSON)


def test_ranks_as_tiktoken(spark):
    texts = awkward(1, 1500)
    ranks = byte_bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_tokens string").repartition(4)
    got = {r.doc_id: r for r in byte_bpe.digests(df, RANKS, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_empty(spark):
    texts = awkward(2, 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = byte_bpe.encoded(df, RANKS, P.PATTERN)
    back = {r.doc_id: r.text for r in byte_bpe.decoded(enc, RANKS, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.digests(df.filter("doc_id < 0"), RANKS, P.PATTERN).collect() == []


def test_units_with_a_tiny_cache(monkeypatch):
    texts = awkward(3, 300)
    lib = library()
    small = packed_ids.LibraryEncoder(JSON, units=50, ids=200).units
    monkeypatch.setattr(units, "CHUNK", 500)
    buf, off = S.text_buffer(pa.array(texts, pa.string()))
    ids, at = small.texts(buf, off)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << min(width, 31), 1000).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == (1000 * width + 7) // 8
    assert packed_ids.unpack(data, width, 0, 1000).tolist() == ids.tolist()
    assert packed_ids.unpack(data, width, 333, 77).tolist() == ids[333:410].tolist()


def test_width():
    assert [packed_ids.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [
        1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_files(spark, block):
    texts = awkward(4, 400)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows],
                               "doc_id long, text string, start int").repartition(6)
    folder = scratch_path(spark, "packed")
    packed_ids.write(df, folder, JSON, block_ids=block)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32)
                 for r in packed_ids.documents(spark, folder).collect())
    lib, start, want = library(), 0, []
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    for d, t in order:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_files(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").filter("doc_id > 1")
    folder = scratch_path(spark, "packed")
    packed_ids.write(df, folder, JSON)
    assert packed_ids.documents(spark, folder).collect() == []
