"""A text beyond the symbols that are handled at once (2**20 bytes), among
small ones, through every operator that reads texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from statline.llm import (
    byte_bpe,
    cotraining,
    decision_list,
    decontaminate,
    fm_index,
    minhash_dedup,
    packed_ids,
    sequences,
    sharding,
    suffix_dedup,
    toxicity,
)
from statline.session import scratch_path

import test_decontaminate
import test_minhash
import test_repeats


def make():
    r = random.Random(9)
    voc = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    word = lambda n: [r.choice(voc) for _ in range(n)]
    long, passage = word(220_000), word(60)
    long[70_000:70_060] = long[180_000:180_060] = passage
    other = list(long)
    other[5] = "changed"  # a near copy of the long text
    rows = [(1, " ".join(word(30))), (2, " ".join(long)), (3, " ".join(word(9) + passage + word(9))),
            (4, None), (5, ""), (6, " ".join(other)), (7, " ".join(word(400)))]
    assert len(rows[1][1].encode()) > sequences.CHUNK
    return rows, " ".join(passage[20:45])


ROWS, ITEM = make()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_repeated_passages(docs):
    few = [ROWS[i] for i in (0, 1, 2, 3, 4, 6)]
    part = docs.filter("doc_id <> 6")
    assert rows_of(suffix_dedup.digests(part)) == test_repeats.brute_bytes(few, 200)
    assert rows_of(fm_index.digests(part)) == test_repeats.brute_words(few, 13)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (2, "not there at all")], "item_id long, text string")
    want = test_decontaminate.brute(ROWS, [(1, ITEM), (2, "not there at all")])
    assert rows_of(decontaminate.digests(docs, items)) == want
    assert {w[0] for w in want if w[5]} == {2, 3, 6}


def test_near_copies(docs):
    got = rows_of(minhash_dedup.groups(docs, 3, 85, 40, 7))
    assert got == test_minhash.brute(ROWS, 3, 85)
    assert {g[0]: g[2] for g in got}[6] == 2


def test_tokens(spark, docs):
    texts = {d: t or "" for d, t in ROWS}
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=ranks)
    for r in byte_bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    folder = scratch_path(spark, "packed")
    packed_ids.write(docs, folder, P.path("byte_bpe_50k.json"))
    lib, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for r in sorted(packed_ids.documents(spark, folder).collect()):
        ids = [*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_models_and_shards(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(1, 8)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert len(score) == 7 and all(0 <= s <= 1 for s in score.values())
    assert len(cotraining.scored(docs, labels).collect()) == 7
    counts = {r.doc_id: r.n_words for r in decision_list.judged(docs, labels).collect()}
    assert counts == {d: len((t or "").split()) for d, t in ROWS}
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard(docs, scratch_path(spark, "map")).collect()}
    assert got == {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in ROWS}
