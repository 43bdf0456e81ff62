"""Quality by co-training of two views.

* text view: hashed shapes of words (runs of upper case, lower case, digits and
  each sign), shapes of neighbours, and echoes of the word before
* metadata view: lang, source and the page's layout (length, lines, words per
  line, repeated lines) in buckets of a factor of two

Each view has its own logistic classifier, fitted on a bounded sample of
labelled documents.  In every round each classifier scores all unlabelled
documents, and the documents it is surest of become pseudo-labelled examples
for the other one.  In the end both views are calibrated on labelled documents
that no classifier saw, and a logistic combination of the two calibrated logits
scores every document.

The features of all documents are written once; the rounds read that table.
Only the bounded sample and the bounded choice of a round (``GROWTH`` documents
of each class and view) come to the driver.

Defined cases: null and empty texts have layout features only; null lang,
source or n_chars are values of their own; repeated rows get equal scores;
without labelled rows of both classes every score is the share of good labels
(1.0 without any label); an empty table gives no rows; other columns are
ignored.  In a round, ties go to the smaller doc_id; documents without an id
are scored and not learned from, and of documents with equal features in both
views one is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import stored
from statline.llm.stats import counts, held_out, labelled_sample

SAMPLE = 20_000
BITS = 16
ROUNDS = 3
GROWTH = 300
THRESHOLD = 0.5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = ord("U")
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("l")
_CLASS[0x30:0x3A] = ord("d")
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def _distinct(row: np.ndarray, key: np.ndarray, n: int):
    both = np.unique(row.astype(np.uint64) << np.uint64(BITS) | key >> np.uint64(64 - BITS))
    return ((both & np.uint64((1 << BITS) - 1)).astype(np.uint16),
            np.searchsorted(both >> np.uint64(BITS), np.arange(n + 1)))


def text_view(buf: np.ndarray, offsets: np.ndarray):
    """Distinct hashed shapes of every row and their offsets."""
    n = len(offsets) - 1
    kind = _CLASS[buf]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    starts, ends, rows = S.words(kind[keep], at)
    shape = S.word_hashes(kind[keep], starts, ends)
    row = np.repeat(np.arange(n), np.diff(rows))
    pair = S.mix(shape[1:] + shape[:-1] * np.uint64(S.BASE))[row[1:] == row[:-1]]
    pair_row = row[1:][row[1:] == row[:-1]]
    full_start, full_end, full = S.words(buf, offsets)
    word = S.word_hashes(buf, full_start, full_end)
    full_row = np.repeat(np.arange(n), np.diff(full))
    echo = np.flatnonzero((word[1:] == word[:-1]) & (full_row[1:] == full_row[:-1]))
    echo_key = np.full(len(echo), S.mix(np.array([77], np.uint64))[0])
    return _distinct(np.concatenate([row, pair_row, full_row[1:][echo]]),
                     np.concatenate([shape, pair, echo_key]), n)


def metadata_view(buf: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array,
                  n_chars: pa.Array):
    """Distinct hashed buckets of every row and their offsets."""
    n = len(offsets) - 1
    got = counts(buf, offsets)
    lines = np.maximum(got["n_lines"], 1)
    chars = n_chars.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    numbers = [chars, got["n_lines"], got["n_words"] / lines, np.diff(offsets) / lines,
               32 * got["n_dup_lines"] / lines]
    keys = [S.mix(np.floor(np.log2(np.maximum(x, 0) + 1) * 2).astype(np.uint64)
                  + np.uint64(1000 * (i + 1))) for i, x in enumerate(numbers)]
    for i, column in enumerate((lang, source)):
        raw, at = S.text_buffer(column.cast(pa.string()))
        keys.append(S.mix(S.word_hashes(raw, at[:-1], at[1:]) + np.uint64(i + 1))
                    if len(raw) else np.full(n, np.uint64(i + 1)))
    return _distinct(np.tile(np.arange(n), len(keys)), np.concatenate(keys), n)


def table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, labelled, text and meta features of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off):
                part, at = buf[off[a]:off[b]], off[a:b + 1] - off[a]
                own = batch.slice(a, b - a)
                views = [text_view(part, at), metadata_view(
                    part, at, *(own.column(c) for c in ("lang", "source", "n_chars")))]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out")]
                    + [pa.array([f[x:y].tobytes() for x, y in zip(o[:-1], o[1:], strict=True)],
                                pa.binary()) for f, o in views],
                    names=["doc_id", "held_out", "text", "meta"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))
    features = base.mapInArrow(run, "doc_id long, held_out boolean, text binary, meta binary")
    known = labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("labelled", F.lit(True))
    return stored(features.join(known, "doc_id", "left").withColumn(
        "labelled", F.coalesce("labelled", F.lit(False))), "views")


@dataclass
class Linear:
    bias: float
    weights: np.ndarray

    def logits(self, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[feature])])
        return self.bias + total[offsets[1:]] - total[offsets[:-1]]


def _flat(parts: list[bytes]):
    arrays = [np.frombuffer(p, np.uint16) for p in parts]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint16)).astype(np.int64), offsets


def fit(parts: list[bytes], label: np.ndarray, steps: int = 150, rate: float = 0.5,
        decay: float = 1e-4) -> Linear:
    """Logistic regression by full-batch AdaGrad; features of fewer than three
    documents stay at zero."""
    feature, offsets = _flat(parts)
    size, n = 1 << BITS, max(1, len(label))
    share = min(max(float(label.mean()) if len(label) else 0.5, 1e-3), 1 - 1e-3)
    model = Linear(float(np.log(share / (1 - share))), np.zeros(size))
    row = np.repeat(np.arange(len(label)), np.diff(offsets))
    seen = np.bincount(feature, minlength=size) >= 3
    row, feature = row[seen[feature]], feature[seen[feature]]
    gw, gb = np.full(size, 1e-8), 1e-8
    for _ in range(steps if 0 < label.sum() < len(label) else 0):
        margin = model.bias + np.bincount(row, model.weights[feature], len(label))
        slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label) / n
        g = np.bincount(feature, slope[row], size) + decay * model.weights
        gw += g * g
        model.weights -= rate * g / np.sqrt(gw) / 4
        gb += slope.sum() ** 2
        model.bias -= rate * slope.sum() / np.sqrt(gb) / 4
    return model


def platt(logit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slopes and intercept of a logistic model on a few logits, by Newton
    steps with a little shrinkage."""
    x = np.column_stack([logit, np.ones(len(label))])
    beta = np.zeros(x.shape[1])
    target = np.clip(label, 1 / (len(label) + 2), 1 - 1 / (len(label) + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta -= np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * beta)
    return beta


@dataclass
class CoTrained:
    views: dict[str, Linear]
    calibration: dict[str, np.ndarray]
    blend: np.ndarray

    def scores(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out, logits = {}, []
        for view, model in self.views.items():
            feature, offsets = _flat(batch.column(view).to_pylist())
            slope, shift = self.calibration[view]
            logits.append(np.clip(slope * model.logits(feature, offsets) + shift, -12, 12))
            out[view] = 1 / (1 + np.exp(-logits[-1]))
        z = np.column_stack(logits) @ self.blend[:-1] + self.blend[-1]
        return out | {"score": 1 / (1 + np.exp(-z))}


def _surest(pool: DataFrame, views: dict[str, Linear], growth: int, used: dict[str, set]) -> list:
    """The ``growth`` unlabelled documents of each class that each view is
    surest of and has not passed on yet (``used``).

    A task passes on ids only, no more than ``growth`` of each kind, and
    documents with equal features in both views once.  The best of them are
    found in two steps, so no task ranks more than a bounded number of rows;
    then the features of the chosen are fetched."""
    done = {v: np.array(sorted(ids), dtype=np.int64) for v, ids in used.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            key = np.asarray(batch.column("alike"))
            for view, model in views.items():
                logit = model.logits(*_flat(batch.column(view).to_pylist()))
                fresh = ~np.isin(ids, done[view])
                for good in (True, False):
                    sure = logit if good else -logit
                    top = np.flatnonzero(fresh & (sure > 0))
                    top = top[np.lexsort((ids[top], -sure[top]))]
                    _, first = np.unique(key[top], return_index=True)
                    top = top[np.sort(first)][:growth]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([view] * len(top), pa.string()),
                         pa.array(np.full(len(top), good)), pa.array(sure[top]), pa.array(ids[top]),
                         pa.array(key[top])], names=["view", "good", "sure", "doc_id", "alike"])

    alike = F.xxhash64("text", "meta")
    # copies, and documents passed on by several tasks, count once
    found = (pool.filter("doc_id is not null").select("doc_id", "text", "meta", alike.alias("alike"))
             .mapInArrow(run, "view string, good boolean, sure double, doc_id long, alike long")
             .groupBy("view", "good", "alike").agg(F.max(F.struct(
                 "sure", (-F.col("doc_id")).alias("before"))).alias("best"))
             .select("view", "good", "best.sure", (-F.col("best.before")).alias("doc_id"))
             .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))))
    order = [F.desc("sure"), F.col("doc_id")]
    for keys in (["view", "good", "salt"], ["view", "good"]):
        found = (found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                 .filter(F.col("place") <= growth))
    chosen = F.broadcast(stored(found.select("view", "good", "place", "doc_id"), "surest"))
    return (pool.select("doc_id", "text", "meta").join(chosen, "doc_id")
            .groupBy("view", "good", "place", "doc_id")
            .agg(F.min("text").alias("text"), F.min("meta").alias("meta"))
            .orderBy("view", "good", "place").collect())


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS,
          growth: int = GROWTH) -> CoTrained:
    chosen = labelled_sample(labels, "quality", sample)
    rows = (features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
            .agg(F.max("label").alias("label"), F.min("text").alias("text"),
                 F.min("meta").alias("meta")).collect())
    rows = sorted(rows, key=lambda r: r.doc_id)
    fold = S.mix(np.array([r.doc_id for r in rows], dtype=np.int64).astype(np.uint64)) % np.uint64(4)
    learn = [r for r, f in zip(rows, fold, strict=True) if f]
    check = [r for r, f in zip(rows, fold, strict=True) if not f]
    other = {"text": "meta", "meta": "text"}
    parts = {v: [getattr(r, v) for r in learn] for v in other}
    label = {v: [float(r.label) for r in learn] for v in other}
    views = {v: fit(parts[v], np.array(label[v])) for v in other}
    pool = features.filter("not labelled and not held_out")
    used: dict[str, set] = {v: set() for v in other}
    for _ in range(rounds if 0 < sum(label["text"]) < len(learn) else 0):
        found = _surest(pool, views, growth, used)
        if not found:
            break
        for r in found:
            used[r.view].add(r.doc_id)
            to = other[r.view]
            parts[to].append(getattr(r, to))
            label[to].append(float(r.good))
        views = {v: fit(parts[v], np.array(label[v])) for v in other}
    truth = np.array([float(r.label) for r in check])
    calibration, logits = {}, []
    for v in other:
        raw = views[v].logits(*_flat([getattr(r, v) for r in check])) if check else np.zeros(0)
        calibration[v] = platt(raw[:, None], truth) if 0 < truth.sum() < len(truth) \
            else np.array([1.0, 0.0])
        logits.append(np.clip(calibration[v][0] * raw + calibration[v][1], -12, 12))
    blend = platt(np.column_stack(logits), truth) if 0 < truth.sum() < len(truth) \
        else np.array([0.5, 0.5, 0.0])
    if not rows:
        blend = np.array([0.0, 0.0, np.inf])
    return CoTrained(views, calibration, blend)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS,
           growth: int = GROWTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (good quality), text_score, metadata_score,
    predicted and kept of every row."""
    features = table(docs, labels)
    model = train(features, labels, sample, rounds, growth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(batch)
            good = got["score"] >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(got["score"]),
                 pa.array(got["text"]), pa.array(got["meta"]), pa.array(good.astype(np.int32)),
                 pa.array(good)],
                names=["doc_id", "held_out", "score", "text_score", "metadata_score", "predicted",
                       "kept"])

    return features.select("doc_id", "held_out", "text", "meta").mapInArrow(
        run, "doc_id long, held_out boolean, score double, text_score double, "
             "metadata_score double, predicted int, kept boolean")
