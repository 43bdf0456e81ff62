"""Corpus pipeline: five stages over ``documents``, each one operator of
``statline.llm``.  Every stage's rows are written as Parquet in the shared
folder and read again as the next stage's input, so a lost executor repeats
one stage at most.  All stages but the last return the columns of their input.

Defined cases, for every stage: null and empty texts are clean, have no copies
and stay (cutting leaves an empty text for either); rows without a doc_id are
documents of their own, rows that repeat a doc_id with other texts too; of
rows that repeat doc_id and text one stays, the first by its other columns;
ties go to the smaller doc_id; an empty table stays empty; other columns, of
any name and type, are carried along unread.  ``n_chars``, where there is such
a column, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.llm import byte_bpe, decontaminate, minhash_dedup, suffix_dedup, toxicity
from statline.llm.batches import for_texts
from statline.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return for_texts(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents scored as toxic go."""
    return toxicity.clean(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, five words and 0.8: of each group the document with the
    smallest id stays (without an id, the one with the smallest hash); of rows
    with equal id and text one stays."""
    for_texts(spark)
    found = minhash_dedup.nodes(docs, size=5, percent=80, bands=48, rows=6)
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"),
                                       F.col("th").alias("kept_th")).distinct()
    # the whole row in one column, so no name of its columns can meet another
    rows = docs.select(F.col("doc_id").alias("id"), minhash_dedup.text_hash().alias("th"),
                       F.struct(*docs.columns).alias("whole"))
    first = F.min_by("whole", F.to_json(F.struct([F.col("whole")[c].alias(c) for c in docs.columns
                                                  if c != "text"])))
    return (rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id"))
                      & (F.col("th") == F.col("kept_th")), "left_semi")
            .groupBy("id", "th").agg(first.alias("whole")).select("whole.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated strings of 200 bytes go from the texts; n_chars
    counts what remains."""
    for_texts(spark)
    others = [c for c in docs.columns if c != "text"]
    cut = suffix_dedup.remaining(docs.select("doc_id", "text", F.struct(*others).alias("others")),
                                 columns=["others"])
    new = {c: F.col("others")[c] for c in others} | {"text": F.col("kept")}
    if "n_chars" in others:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a passage of a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token counts and digests of ids and of the decoded bytes."""
    for_texts(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

# A trained classifier and a tokenizer decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage_{i + 1}_{name.replace(' ', '_')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
