"""A training-data pipeline over ``documents``: five stages, each an operator of weftline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, nbsvm, near_dup, piece_lattice, secrets
from weftline.llm.storage import materialize
from weftline.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5)."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), "quality", nbsvm.held_out(3, 1))
    return nbsvm.score(docs, model).where("score >= 0.5").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies: shingles of five words, similarity 0.8 or more.

    Rows that share a doc_id stay or go together; rows without one stay.
    """
    found = near_dup.near_duplicates(docs, k=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts redacted and n_chars counted anew."""
    found = secrets.with_spans(docs)
    text = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    return text.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces): a sampled SentencePiece segmentation of each text."""
    return piece_lattice.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", tokenize),
]

#: SQL cannot express the classifier's fit or the sampled segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
