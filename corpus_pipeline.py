"""A corpus pipeline: grade, deduplicate, scan for secrets, mix and pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import minhash, mixing, ordinal, packing, secrets
from millrace.llm.common import stage, table


#: The chance of the top grade that a document needs to stay.
LEAST = 0.5
#: The similarity, in percent, from which documents are near copies. op5's contract has 85.
NEAR = 80


# Every stage: a null text counts as empty, repeated rows and null ids or sources
# are rows like others unless said, an empty table gives an empty table, and columns
# beside those of documents stay as they are, whatever they are called.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is one half or more. Without
    ratings nothing is known against a text, and the thresholds' prior decides."""
    model = ordinal.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ordinal.accepted(docs, model, LEAST)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links of ``NEAR`` percent or more, the one
    with the smallest doc_id; of several rows of that id the one whose text has
    the smallest hash. Texts without words link with nothing, rows without
    doc_id neither: both stay, repeated ones once for each doc_id."""
    groups = minhash.near_duplicates(docs, NEAR).where("doc_id is not null")
    gone = groups.where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    left = named.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    left = left.select(F.col("doc_id"), F.col("text"), row.alias("row")).withColumn("nth", nth).where("nth = 1")
    left = left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return left.unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return secrets.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most; those without words once."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: The trained and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
