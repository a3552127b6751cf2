"""Corpus pipeline: from raw documents to the tokens of a training mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents. ``run`` applies them to the table of documents, each written as Parquet in the
shared folder and read again, so that a lost executor costs no more than its stage.

Each stage looks at all documents that its predecessor kept, whole texts included. Null texts are
kept by the first stage (nothing in them is toxic) and dropped by the second, as they have no
language. The columns of ``documents`` go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, language, mixing, neardup, toxicity
from driftline.llm.common import read, written

#: The rule for stages on word shingles; 85 is the contract of op7 only.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return language.drop_unclear(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word shingles, similarity of 0.8 or more) the document with the smallest id stays."""
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each row, their number, and digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs).select(
        "doc_id", "ids",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the first stages; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
