"""A corpus pipeline of five stages over ``documents``; each works on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. A stage reads ``docs``
more than once, so the caller writes each result and reads it again, as ``run`` does. A result is read from what its stage has
written, which stays until ``common.release``, or until the end of the scope that the caller has opened.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.llm import decontamination, jaccard, packing, suffix, toxicity
from fathomlake.llm.common import cut, discard, documents, drop, noted, small, written


#: The column that tells rows apart inside a stage.
ROW = "_fathomlake_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The score depends on the text alone, so rows without doc_id are judged too."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, scorer)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one stays: that of the smallest doc_id, rows without doc_id last.

    Rows are told apart by an id of their own, so one that repeats a doc_id or has none is judged by its own text.
    """
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    classes = jaccard.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).where("n_links > 0")
    named = rows.select(F.col(ROW).alias("row_id"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    members = cut(classes.select(F.col("doc_id").alias("row_id"), "class_id").join(named, "row_id"), "classes")
    first = members.groupBy("class_id").agg(F.min(F.struct("unnamed", "doc_id", "row_id"))["row_id"].alias("first_id"))
    gone = members.join(first, "class_id").where("row_id <> first_id").select(F.col("row_id").alias(ROW))
    return rows.join(small(cut(gone, "gone")), ROW, "left_anti").drop(ROW)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of over 50 words that occur elsewhere go, in all places; the documents stay, ``n_chars`` is counted anew."""
    left = suffix.remove_repeats(docs, ["n_removed", "kept"], suffix.PASSAGE, suffix.WORDS)
    anew = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return left.select(*[anew.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of the shingles of a test item go."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_array_dedup", drop_repeated_bytes),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the fourth can be said in SQL with its method; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(documents(spark, sf_dir), sf_dir)


@written
def _run(docs: DataFrame, sf_dir: str) -> DataFrame:
    spark, before = docs.sparkSession, []
    for name, function in STAGES[:-1]:
        with noted(spark) as left:
            out = function(spark, docs, sf_dir)
        docs = cut(out, f"stage-{name}")
        discard(spark, left)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
