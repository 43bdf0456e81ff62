"""The pipeline's stages on planted cases, and the whole run on a small table."""

import hashlib

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_near_copies(spark):
    rows = [(5, words("a", 60)), (2, words("a", 59) + " other"), (9, words("b", 60)), (9, words("b", 60)),
            (11, None), (12, ""), (None, words("c", 30))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [11, 12, 2, 9, None]


def test_repeats_are_cut(spark):
    shared = words("s", 60)
    rows = [(1, "x " + shared), (2, "y " + shared), (3, "clean"), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d}", 1) for d, t in rows], SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert out[3].text == "clean" and out[3].n_chars == 5 and out[3].source == "s3"
    assert out[1].text.strip() == "x" and out[2].text.strip() == "y" and out[4].text == ""


def test_leaks_and_toxic(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").first()
    docs = spark.createDataFrame([(1, "before " + item.text.upper() + " after", "en", "s", 1),
                                  (2, "nothing to see here", "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()] == [2]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, rows = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        rows.append(kept.count())
    assert docs.count() >= rows[0] >= rows[1] >= rows[2] >= rows[3] > 0.5 * docs.count()
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())
                  for r in kept.collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == want


def test_near_copies_without_ids(spark):
    rows = [(5, words("a", 60)), (None, words("a", 59) + " other"), (None, words("b", 60)),
            (None, words("c", 60)), (None, words("c", 59) + " other"), (None, ""),
            (3, words("d", 60)), (7, words("d", 60)), (7, words("e", 60))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    c = [x for x in out if x[1].startswith("c0 ")]
    assert len(c) == 1
    assert sorted((x for x in out if x not in c), key=str) == sorted(
        [rows[i] for i in (0, 2, 5, 6, 8)], key=str)


FILTERS = [stage for _, stage in corpus_pipeline.STAGES[:-1]]
CLASHES = ["kept", "n_removed", "n_bytes", "n_spans", "kept_id", "kept_th", "__copy", "th", "whole", "others",
           "id", "label", "rep", "hits", "row"]


@pytest.mark.parametrize("stage", FILTERS)
def test_other_columns_are_carried_along(spark, stage):
    """Columns of any name, and of types that have no order."""
    rows = [(i, words(f"t{i}", 50), [f"{c}{i}" for c in CLASHES], {"k": i}) for i in range(4)]
    docs = spark.createDataFrame([(i, t, m, *c) for i, t, c, m in rows],
                                 "doc_id long, text string, map map<string, int>, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("stage", FILTERS)
def test_two_columns_and_empty_tables(spark, stage):
    rows = [(1, words("a", 40)), (2, None), (3, ""), (None, words("b", 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text or "") for r in stage(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(d, t or "") for d, t in rows], key=str)
    assert stage(spark, docs.filter("doc_id > 9"), SF).collect() == []


def test_one_of_equal_rows_stays(spark):
    rows = [(1, words("a", 40), x) for x in "cabd"] + [(2, words("a", 40), "z"), (None, "", "q"), (None, "", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.lang) for r in out), key=str) == [(1, "a"), (None, "p")]
