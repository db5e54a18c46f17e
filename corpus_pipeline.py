"""A corpus pipeline of five stages over the documents table; each stage's rows are written and read again by the next."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from sparkcohort.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec  # noqa: E402
from sparkcohort.llm.common import read  # noqa: E402
from sparkcohort.session import ensure_checkpoint_dir  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from labelled documents among those it is given."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of similar word n-grams the one with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the ids of the text's pieces."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.load(), keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("source mixing", mixing_stage), ("SentencePiece encoding", encoding_stage)]

#: The classifier and the balanced sample have no SQL form; tests hold copies, near copies and mixing against plain Python,
#: encoding against decoding, and the classifier's stage against its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; in between, rows are Parquet files in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return out
