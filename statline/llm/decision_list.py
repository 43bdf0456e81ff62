"""Quality rules as a learned decision list.

Every document gets counts and ratios (``features``).  On a bounded sample of
labelled documents, sequential covering learns rules for low quality: a rule
grows by the threshold condition with the best information gain, is pruned on
other documents, and leaves the documents that it covers out for the next
rule.  The list is emitted as one ordered Spark conditional expression, which
judges all documents without Python.

A document is kept if it passes the fixed base checks and no rule fires.

Defined cases: null and empty texts and texts without words have all counts 0,
fail the base check and are dropped; ratios of empty texts are 0; repeated
rows get equal verdicts; without labelled rows the list is empty and the base
checks decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm import sequences as S
from statline.llm.components import stored
from statline.llm.stats import counts, held_out, labelled_sample

SAMPLE = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48
MIN_PRECISION = 0.9

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_upper", "n_digits", "n_marks", "n_stops", "n_echoes")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = S.text_buffer(batch.column("text"))
            for a, b in S.chunks(off):
                got = counts(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a)]
                    + [pa.array(got[c].astype(np.int64)) for c in _COUNTS],
                    names=["doc_id", *_COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def features() -> dict[str, Column]:
    """Statistics that conditions may test, as expressions over the counts."""
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "word_chars"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
        "upper_share": ratio("n_upper", "word_chars"),
        "digit_share": ratio("n_digits", "word_chars"),
        "marks_per_word": ratio("n_marks", "n_words"),
        "stops_per_word": ratio("n_stops", "n_words"),
        "echo_share": ratio("n_echoes", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, known: dict[str, Column]) -> Column:
        x = known[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the best gain (bits saved on the bad documents
    that stay covered) until no good document is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        best, chosen = 1e-9, None
        for name, x in sorted(values.items()):
            cuts = np.unique(np.quantile(x[inside], np.linspace(0, 1, CUTS + 1)[:-1]))
            # cuts among the bad documents too, as they are few
            cuts = np.unique(np.concatenate(
                [cuts, np.quantile(x[inside & bad], np.linspace(0, 1, CUTS // 2 + 1)[:-1])]))
            order = np.argsort(x[inside], kind="stable")
            ordered = x[inside][order]
            hits = np.concatenate([[0], np.cumsum(bad[inside][order])])
            at = np.searchsorted(ordered, cuts, side="right")
            for above in (True, False):
                q = hits[-1] - hits[at] if above else hits[at]
                m = n - at if above else at
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(q > 0, q * (np.log2(q / m) - np.log2(p / n)), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, chosen = gain[i], Condition(name, above, float(cuts[i]))
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule with the best (bad - good) / covered on
    documents that did not grow it; with that precision and cover."""
    best: tuple = (-2.0, (), 0.0, 0)
    for size in range(1, len(rule) + 1):
        inside = covers(rule[:size], values)
        n, p = int(inside.sum()), int((inside & bad).sum())
        if n and (2 * p - n) / n > best[0]:
            best = ((2 * p - n) / n, rule[:size], p / n, n)
    return best[1], best[2], best[3]


def learn(values: dict[str, np.ndarray], bad: np.ndarray, key: np.ndarray) -> list[Rule]:
    """Ordered rules for bad documents.

    Each rule is pruned on another third of the documents (by a hash of
    ``key`` and the rule's number).  A rule must be right on ``MIN_PRECISION``
    of all documents left that it covers, and on its pruning third; where that
    third has no bad document, on all it covers, three or more.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    for turn in range(MAX_RULES + 6):
        fold = S.mix(key.astype(np.uint64) + np.uint64(turn * S.BASE % (1 << 64))) % np.uint64(3)
        grow, prune = left & (fold != 0), left & (fold == 0)
        if not (bad & grow).any() or len(rules) == MAX_RULES:
            break
        rule = _grow({k: x[grow] for k, x in values.items()}, bad[grow])
        least = MIN_PRECISION
        if (bad & prune).any():
            rule, precision, _ = _prune(rule, {k: x[prune] for k, x in values.items()}, bad[prune])
            if precision < MIN_PRECISION:
                continue
        else:
            least = 1.0
        if not rule:
            continue
        inside = left & covers(rule, values)
        if inside.sum() < 3 or (inside & bad).sum() < least * inside.sum():
            continue
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the number of the first rule that
    fires, null if none does."""
    known = features()
    out: Column | None = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(known)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents outside the held-out
    fold; ``measured`` has the counts of all documents."""
    chosen = labelled_sample(labels, "quality", sample)
    known = features()
    rows = (measured.join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "label", *[c.alias(n) for n, c in known.items()])
            .groupBy("doc_id").agg(F.min(F.struct("label", *known)).alias("row"))  # repeated ids
            .select("doc_id", "row.*"))
    got = sorted(map(tuple, rows.collect()))
    if not got:
        return []
    table = np.array([r[2:] for r in got], dtype=np.float64)
    values = {n: table[:, i] for i, n in enumerate(known)}
    bad = np.array([r[1] == 0 for r in got])
    return learn(values, bad, np.array([r[0] for r in got]))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (the one that fired) and
    held_out of every row."""
    measured = stored(document_counts(docs), "document_counts")
    rules = train(measured, labels, sample)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measured.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
                    held_out().alias("held_out")))
