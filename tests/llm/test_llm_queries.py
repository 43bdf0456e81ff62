"""The registered queries against their SQL and, where there is none, against
the libraries or brute force, on the shared tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from statline.llm import byte_bpe, queries

from test_repeats import brute_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = ", ".join(df.columns)
    want = con.execute(f"SELECT {cols} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_op5_equals_the_library(spark, texts):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.read_ranks(
        P.path("byte_bpe_50k.tiktoken")))
    got = queries.op5_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op2_equals_the_library(spark, texts):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, queries.op2_packed_token_ids(spark, SF).collect()))
    start, want = 0, []
    for d, t in sorted(texts.items()):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_op10_equals_brute_force(spark, texts):
    got = sorted(map(tuple, queries.op10_suffix_array_dedup(spark, SF).collect()), key=str)
    assert got == brute_bytes(sorted(texts.items()), 200)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {
    "op12_embedding_whitening", "op13_site_template_text"}))
def test_one_row_per_document(spark, texts, name):
    df = queries.queries()[name](spark, SF)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(texts)
