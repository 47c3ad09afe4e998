"""The corpus pipeline: quality, language, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of docs. A document here is a row with an id: rows without
one cannot be decided on by later stages and are kept by the filters as they are. Rows that share an id are kept or
dropped together, so if a filter rejects one of them, all go; give rows ids of their own to have them judged apart.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, language_id, near_dedup, packing, quality_rules
from strandloom.llm.common import shared_folder, table

#: A document stays from this score of quality on, and from this confidence in its language on.
QUALITY_SCORE, LANGUAGE_SCORE = 0.5, 0.5

#: SQL cannot express the trained stages; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the ids in rejected, with all their columns."""
    gone = rejected.select(F.col("doc_id").alias("rejected_id"))
    return docs.join(gone, docs["doc_id"] == gone["rejected_id"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return without(docs, quality_rules.classify(docs, model, at_least=QUALITY_SCORE).where("predicted = 0"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    found = language_id.identify(docs, language_id.fit(docs))
    unsure = (F.col("lang_pred") == language_id.UNDETERMINED) | (F.col("score") < LANGUAGE_SCORE)
    return without(docs, found.where(unsure))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without(docs, exact_dedup.exact_duplicates(docs).where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 0.8 or more."""
    return without(docs, near_dedup.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces in sequences of at most 2048 tokens."""
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)
    return packing.pack(pieces, capacity=2048)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/strandloom/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
