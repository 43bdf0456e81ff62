"""Byte-level BPE through sentencepiece.

A rank file becomes a sentencepiece BPE model directly: every vocabulary entry
is a piece whose bytes are written as one printable character each, with the
negative rank as score, so that sentencepiece's best-scored merge is the
lowest rank; normalisation is the identity and nothing is added or escaped.
Texts are cut by the pre-token pattern, each pre-token is encoded alone, and a
pre-token that is itself an entry is that entry (as in the rank file's own
library).  Ids are ranks.  Decoding is the inverse mapping: the bytes of each
id, joined.

Defined cases: a null or empty text has no ids and gives the digests of the
empty string; repeated rows are encoded alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from statline.llm import sequences as S
from statline.llm import units
from statline.llm.units import UnitEncoder, gather


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """One printable character for each byte: the byte's own where it prints."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The rank file as a serialised sentencepiece BPE model; piece ``i + 1``
    is the i-th entry in rank order."""
    chars = byte_characters()
    model = model_pb2.ModelProto()
    model.trainer_spec.model_type = model_pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(ranks) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    piece = model.pieces.add()
    piece.piece, piece.score, piece.type = "<unk>", 0.0, model_pb2.ModelProto.SentencePiece.UNKNOWN
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join(chars[b] for b in token), -float(rank)
        piece.type = model_pb2.ModelProto.SentencePiece.NORMAL
    return model.SerializeToString()


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(
            model_proto=sentencepiece_model(self.ranks))
        self.to_char = {b: c for b, c in enumerate(byte_characters())}
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.ids = np.array([r for _, r in order])
        self.rank_of_piece = [-1, *self.ids.tolist()]
        size = int(self.ids.max()) + 1
        # bytes and decimal text of every id, for decoding and digests
        self.token_at, self.token_length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lengths = np.array([len(t) for t, _ in order])
        self.token_at[self.ids], self.token_length[self.ids] = np.cumsum(lengths) - lengths, lengths
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)
        decimals = [b"%d " % i for i in range(size)]
        self.decimal_length = np.array([len(d) for d in decimals])
        self.decimal_at = np.cumsum(self.decimal_length) - self.decimal_length
        self.decimal_bytes = np.frombuffer(b"".join(decimals), np.uint8)
        self.units = UnitEncoder(self.encode_text, self.encode_parts, self.token_length)

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.encode_parts([text])[0], dtype=np.uint32)

    def encode_parts(self, texts: list[str]) -> list[list[int]]:
        whole, split, chars = self.ranks.get, self.pattern.findall, self.to_char
        late: list[str] = []
        out: list[list] = []
        for text in texts:
            tokens = [t.encode() for t in split(text)]
            ids = list(map(whole, tokens))
            if None in ids:  # gaps, filled below
                late += [t.decode("latin-1").translate(chars)
                         for t, i in zip(tokens, ids, strict=True) if i is None]
            out.append(ids)
        if late:
            rank = self.rank_of_piece
            found = iter(self.pieces.encode(late, out_type=int, num_threads=1))
            for at, ids in enumerate(out):
                if None in ids:
                    full: list[int] = []
                    for i in ids:
                        if i is None:
                            full += [rank[x] for x in next(found)]
                        else:
                            full.append(i)
                    out[at] = full
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray):
        """Bytes of all ids and the offsets of the rows."""
        raw, ends = gather(self.token_bytes, self.token_at[ids], self.token_length[ids])
        return raw, ends[offsets]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray):
        raw, ends = gather(self.decimal_bytes, self.decimal_at[ids], self.decimal_length[ids])
        return raw, ends[offsets]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per Python worker."""
    return ByteBpe(path, pattern)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def _pieces(batches, path: str, pattern: str):
    for batch in batches:
        buf, off = S.text_buffer(batch.column("text"))
        own = batch.column("doc_id")
        for a, b in S.chunks(off, units.CHUNK):
            ids, at = codec(path, pattern).units.texts(buf[off[a]:off[b]], off[a:b + 1] - off[a])
            yield own.slice(a, b - a), ids, at


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def digest(raw: np.ndarray, off: np.ndarray, trim: int = 0) -> pa.Array:
        data = memoryview(raw.tobytes())
        return pa.array([hashlib.sha256(data[x:max(x, y - trim)]).hexdigest()
                         for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)],
                        pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for own, ids, at in _pieces(batches, path, pattern):
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.diff(at)), digest(*bpe.decimals(ids, at), trim=1),
                 digest(*bpe.decode(ids, at))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the array of ids of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids, at in _pieces(batches, path, pattern):
            yield pa.RecordBatch.from_arrays(
                [own, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)),
                                               pa.array(ids.astype(np.int32)))],
                names=["doc_id", "ids"])

    return _columns(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of ``encoded`` (null ids: an empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                got = np.array(ids.as_py() or [], dtype=np.int64)
                raw, _ = bpe.decode(got, np.array([0, len(got)]))
                texts.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
