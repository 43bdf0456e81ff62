"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text (letters, digits and all bytes
beyond ASCII) and the beginnings of long words, each hashed to one of
``2 ** BITS`` features; a document has a feature or not.  The score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over its features, so pairs of terms count beyond their single weights.  The
pairwise sum costs one pass: half of |sum v|^2 - sum |v|^2.

The machine learns the terms that tell something about the label: alone
(``telling``), or together with another term beyond what both tell alone
(``telling_pairs``), as two terms that are harmless apart do.

The machine is fitted with AdaGrad on the driver, on at most ``SAMPLE``
labelled documents outside the held-out fold.  What is collected is bounded by
them and by the terms of a text (four bytes a distinct term, never more than
2 ** BITS of them); scoring is one pass over all documents without a shuffle.  Labels,
lang, source and doc_id are no features.

Defined cases: null and empty texts have no feature and get the score of the
intercept; repeated rows get equal scores; without labelled rows every score
is 0.0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.decontaminate import _WORD
from statline.llm.stats import held_out, labelled_sample

BITS = 18
FACTORS = 4
SAMPLE = 20_000
THRESHOLD = 0.3
PREFIX = 6
EPOCHS = 15
UPDATES = 300
MIN_DOCUMENTS = 3
MIN_DEVIATION = 4.0
# Pairs are looked for among so many terms, those of most documents, but of no
# more than about half of them.
PAIR_TERMS = 1024
MIN_PAIR_DEVIATION = 6.0


def terms(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """Distinct features of every row, sorted, and their offsets."""
    low = S.ascii_lower(buf)
    starts, ends, rows = S.spans_of(_WORD[low], offsets)
    hasher = S.Hasher(S.BYTE_VALUES[low])
    whole = hasher.ranges(starts, ends)
    long = ends - starts > PREFIX
    begin = S.mix(hasher.ranges(starts[long], starts[long] + PREFIX) + np.uint64(1))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    key = np.concatenate([whole, begin]) >> np.uint64(64 - bits)
    row = np.concatenate([row, row[long]])
    both = np.unique(row.astype(np.uint64) << np.uint64(bits) | key)
    feature = (both & np.uint64((1 << bits) - 1)).astype(np.int32)
    return feature, np.searchsorted(both >> np.uint64(bits), np.arange(len(offsets)))


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            at = offsets[:-1][full]
            v = self.factors[feature].astype(np.float64)
            total = np.add.reduceat(v, at, axis=0)
            square = np.add.reduceat((v * v).sum(axis=1), at)
            out[full] += np.add.reduceat(self.weights[feature].astype(np.float64), at) \
                + 0.5 * ((total * total).sum(axis=1) - square)
        return out

    def scores(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.margins(feature, offsets)
        return np.where(np.isneginf(margin), 0.0, 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))))


def telling(feature: np.ndarray, offsets: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """Features whose documents differ in label from all documents by
    ``MIN_DEVIATION`` standard deviations or more; the machine learns pairs
    among these, not noise."""
    if not len(label):
        return np.zeros(size, dtype=bool)
    row = np.repeat(label, np.diff(offsets))
    n = np.bincount(feature, minlength=size)
    hits = np.bincount(feature, row, minlength=size)
    share = label.mean()
    spread = np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / max(1, len(label))), 1e-9))
    return (n >= MIN_DOCUMENTS) & (np.abs(hits - n * share) >= MIN_DEVIATION * spread)


def telling_pairs(feature: np.ndarray, offsets: np.ndarray, label: np.ndarray,
                  size: int) -> np.ndarray:
    """Features of pairs whose documents differ in label by
    ``MIN_PAIR_DEVIATION`` standard deviations from what the two features tell
    alone (their shares added up).  The pairs are those of ``PAIR_TERMS`` terms;
    they are counted by products of the sample's term matrix, block by block."""
    out = np.zeros(size, dtype=bool)
    rows = len(label)
    n = np.bincount(feature, minlength=size)
    common = np.flatnonzero((n >= MIN_DOCUMENTS) & (2 * n <= max(rows, 1) + 4 * np.sqrt(rows)))
    common = common[np.argsort(-n[common], kind="stable")[:PAIR_TERMS]]
    if len(common) < 2 or not 0 < label.sum() < rows:
        return out
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    both = np.zeros((len(common), len(common)), dtype=np.float32)
    hits = np.zeros_like(both)
    for a in range(0, rows, 2000):
        b = min(rows, a + 2000)
        at = place[feature[offsets[a]:offsets[b]]]
        row = np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1]))[at >= 0]
        has = np.zeros((b - a, len(common)), dtype=np.float32)
        has[row, at[at >= 0]] = 1
        both += has.T @ has
        bad = has[label[a:b] > 0]
        hits += bad.T @ bad
    share = label.mean()
    alone = np.diag(hits) / np.diag(both)
    want = np.clip(alone[:, None] + alone[None, :] - share, 0.0, 1.0)
    near = np.clip(want, share / 2, 1 - share / 2)
    spread = np.sqrt(np.maximum(both * near * (1 - near), 1e-9))
    tells = (both >= 5 * MIN_DOCUMENTS) & (np.abs(hits - both * want) >= MIN_PAIR_DEVIATION * spread)
    np.fill_diagonal(tells, False)
    out[common[tells.any(axis=1)]] = True
    return out


def fit(feature: np.ndarray, offsets: np.ndarray, label: np.ndarray, bits: int = BITS,
        factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.4,
        decay: float = 2e-3, seed: int = 11) -> FactorizationMachine:
    """Logistic loss, AdaGrad over small batches, ``epochs`` times over the rows
    and ``UPDATES`` batches at least.  Features that
    tell nothing, alone or in a pair, stay at zero."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    share = min(max(label.mean() if len(label) else 0.0, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(size)
    seen = telling(feature, offsets, label, size) | telling_pairs(feature, offsets, label, size)
    v = np.where(seen[:, None], rng.normal(0, 0.01, (size, factors)), 0.0)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, factors), 1e-1), 1.0
    epochs = max(epochs, -(-UPDATES * 128 // max(1, len(label))))
    for _ in range(epochs if 0 < label.sum() < len(label) else 0):
        order = rng.permutation(len(label))
        for chunk in np.array_split(order, max(1, len(order) // 128)):
            lengths = offsets[chunk + 1] - offsets[chunk]
            row = np.repeat(np.arange(len(chunk)), lengths)
            at = np.repeat(offsets[chunk] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(row))
            x = feature[at]
            keep = seen[x]
            x, row = x[keep], row[keep]
            vx = v[x]
            total = np.stack([np.bincount(row, vx[:, f], len(chunk)) for f in range(factors)], axis=1)
            square = np.bincount(row, (vx * vx).sum(axis=1), len(chunk))
            margin = bias + np.bincount(row, w[x], len(chunk)) \
                + 0.5 * ((total * total).sum(axis=1) - square)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label[chunk]) / len(chunk)
            used, back = np.unique(x, return_inverse=True)
            g = np.bincount(back, slope[row], len(used)) + decay / len(chunk) * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            pull = slope[row][:, None] * (total[row] - vx)
            for f in range(factors):
                g = np.bincount(back, pull[:, f], len(used)) + decay / len(chunk) * v[used, f]
                gv[used, f] += g * g
                v[used, f] -= 0.3 * rate * g / np.sqrt(gv[used, f])
            g = slope.sum()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    if not label.sum():
        bias = -np.inf
    return FactorizationMachine(bias, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fits on a bounded sample; documents with a label stand once each."""
    chosen = labelled_sample(labels, "toxic", sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            feature, at = terms(buf, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array([feature[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
                          pa.binary())], names=["doc_id", "label", "terms"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(extract, "doc_id long, label int, terms binary")
            .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")))
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    parts = [np.frombuffer(r.terms, np.int32) for r in got]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    feature = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return fit(feature, offsets, np.array([r.label for r in got], dtype=np.float64))


def _scores(model: FactorizationMachine, column: pa.Array):
    buf, off = S.text_buffer(column)
    return np.concatenate([np.zeros(0)] + [
        model.scores(*terms(buf[off[a]:off[b]], off[a:b + 1] - off[a])) for a, b in S.chunks(off)])


def scored(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below the threshold, all columns kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
