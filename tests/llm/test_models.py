"""Learned operators: held-out accuracy on the shared labels, the counts of
the quality rules against plain Python, and odd inputs."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from statline.llm import cotraining, decision_list, stats, toxicity
from statline.llm import sequences as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return read("documents"), read("labels")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def odd(spark, docs):
    """Null and empty texts, null ids, repeated rows and clashing columns."""
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, 1.0), (None, "one two", "en", "s", 7, 1.0),
            (3, "a\n" * 3000, "en", "s", 6000, 1.0), (4, "same text", "de", None, 9, 1.0),
            (4, "same text", "de", None, 9, 1.0), (5, " \n\t ", "xx", "s", 4, 1.0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def brute_counts(s):
    s = s or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", s)
    seen, dup, at, cover = set(), 0, {}, set()
    for line in s.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            cover.update(j for i in places for j in range(i, i + 8))
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in s), dup, len(cover))


def test_counts_as_plain_python(tables):
    texts = [r.text for r in tables[0].select("text").limit(300).collect()]
    texts += [None, "", " ", "é日本 #|", "x\nx\n x\n\nx", "a b " * 40, "\n\n"]
    buf, off = S.text_buffer(pa.array(texts, pa.string()))
    got = stats.counts(buf, off)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*[got[n].tolist() for n in names], strict=True)) == [brute_counts(t) for t in texts]


def test_decision_list(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in decision_list.judged(docs, labels).collect()}
    assert len(got) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect()}
    bad = [d for d, q in known.items() if q == 0 and held(d)]
    good = [d for d, q in known.items() if q == 1 and held(d) and not got[d].base_failed]
    assert sum(not got[d].kept for d in bad) >= 0.8 * len(bad)
    assert sum(got[d].kept for d in good) >= 0.97 * len(good)
    for r in got.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_decision_list_odd_inputs(spark, tables):
    rows = odd(spark, tables[0])
    got = decision_list.judged(rows, tables[1]).collect()
    assert len(got) == 7 and not any(r.kept for r in got if r.n_words < 20)
    none = decision_list.judged(rows, tables[1].filter("doc_id < 0")).collect()
    assert len(none) == 7 and all(r.rule is None for r in none)
    assert decision_list.judged(rows.filter("doc_id > 9"), tables[1]).collect() == []


def test_decision_list_learns_from_a_repeated_id_once(spark, tables, monkeypatch):
    docs, labels = tables
    known = {r.doc_id for r in labels.collect() if not held(r.doc_id)}
    one = docs.filter(docs["doc_id"].isin(sorted(known)[:1])).crossJoin(spark.range(300)).drop("id")
    seen = []
    monkeypatch.setattr(decision_list, "learn", lambda values, bad, ids: seen.append(ids.tolist()) or [])
    decision_list.judged(docs.unionByName(one), labels)
    assert len(seen[0]) == len(set(seen[0])) > 100


def test_rules_are_ordered_conditions():
    rng = np.random.default_rng(0)
    x, y = rng.random(3000), rng.random(3000)
    bad = (x > 0.8) | ((y < 0.2) & (x > 0.4))
    rules = decision_list.learn({"x": x, "y": y}, bad, np.arange(3000) % 3)
    fired = np.zeros(3000, bool)
    for rule in rules:
        fired |= decision_list.covers(rule, {"x": x, "y": y})
    assert (fired == bad).mean() > 0.97


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count() and all(got[d].held_out == held(d) for d in known)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    bad = [d for d, t in known.items() if t and held(d)]
    fine = [d for d, t in known.items() if not t and held(d)]
    assert sum(got[d].predicted for d in bad) >= 0.5 * len(bad)
    assert sum(got[d].predicted for d in fine) <= 0.05 * len(fine)


def test_toxicity_learns_pairs():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(5)
    a, b = rng.random(4000) < 0.4, rng.random(4000) < 0.4
    label = (a & b).astype(float)
    parts = [np.flatnonzero([x, y, True]).astype(np.int32) for x, y in zip(a, b, strict=True)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = toxicity.fit(np.concatenate(parts), offsets, label, bits=4, epochs=30)
    score = model.scores(np.array([0, 1, 0, 1], np.int32), np.array([0, 1, 2, 4]))
    assert score[2] > 0.7 and max(score[0], score[1]) < 0.3
    plain = model.margins(np.array([0, 1], np.int32), np.array([0, 2])) - model.bias
    assert plain[0] - model.weights[0] - model.weights[1] == pytest.approx(
        float(model.factors[0] @ model.factors[1]), abs=1e-4)


@pytest.mark.parametrize("kind", ["xor", "and"])
def test_toxicity_learns_pairs_without_own_effect(kind):
    """Two terms whose own documents are as toxic as all others: the label is
    their exclusive or, or they are toxic together and each is made up for."""
    rng = np.random.default_rng(4)
    rows, label = [], []
    for _ in range(6000):
        a, b = rng.random(2) < (0.5 if kind == "xor" else 0.2)
        filler = [f"w{i}" for i in rng.integers(0, 400, 12)]
        rows.append(" ".join(filler + ["lamp"] * int(a) + ["river"] * int(b)))
        p = float(a != b) if kind == "xor" else (0.9 if a and b else 0.0 if a or b else 0.2)
        label.append(float(rng.random() < p))
    buf, off = S.text_buffer(pa.array(rows))
    feature, at = toxicity.terms(buf, off)
    label = np.array(label)
    cut = int(at[4000])
    alone = toxicity.telling(feature[:cut], at[:4001], label[:4000], 1 << toxicity.BITS)
    assert kind == "and" or not alone.any()
    model = toxicity.fit(feature[:cut], at[:4001], label[:4000])
    score = model.scores(feature[cut:], at[4000:] - cut)
    truth = label[4000:] > 0
    order = np.argsort(np.argsort(score))
    auc = (order[truth].mean() - (truth.sum() - 1) / 2) / (~truth).sum()
    assert auc > (0.97 if kind == "xor" else 0.6), auc


def plain_margin(model, feature):
    out = model.bias + sum(float(model.weights[i]) for i in feature)
    for x, i in enumerate(feature):
        for j in feature[:x]:
            out += float(model.factors[i].astype(float) @ model.factors[j].astype(float))
    return out


def test_toxicity_scores_as_all_pairs(spark, tables):
    """The score of a document from its terms and all their pairs."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    for text in [r.text for r in docs.select("text").limit(40).collect()] + ["", None]:
        buf, off = S.text_buffer(pa.array([text], pa.string()))
        feature, at = toxicity.terms(buf, off)
        want = 1 / (1 + np.exp(-plain_margin(model, feature.tolist()))) if len(feature) < 400 else None
        got = model.scores(feature, at)[0]
        assert want is None or abs(got - want) < 1e-5


def test_toxicity_odd_inputs(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    got = toxicity.scored(odd(spark, docs), model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.filter("doc_id < 0"), model).collect() == []
    blank = toxicity.train(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in toxicity.scored(odd(spark, docs), blank).collect()} == {0.0}
    kept = toxicity.clean(odd(spark, docs), model)
    assert kept.columns == odd(spark, docs).columns and kept.count() <= 7


def test_cotraining(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in cotraining.scored(docs, labels, growth=40).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    bad = np.array([got[d].score for d, q in known.items() if q == 0 and held(d)])
    good = np.array([got[d].score for d, q in known.items() if q == 1 and held(d)])
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.93, auc
    assert (good >= 0.5).mean() > 0.97


def test_cotraining_odd_inputs(spark, tables):
    docs, labels = tables
    rows = odd(spark, docs)
    got = cotraining.scored(rows, labels.filter("doc_id < 0")).collect()
    assert len(got) == 7 and {r.score for r in got} == {1.0}
    assert len(cotraining.scored(rows, labels).collect()) == 7
    assert cotraining.scored(rows.filter("doc_id > 9"), labels).collect() == []
