"""The corpus pipeline: five stages of the operators in trailframe.llm, each written and read again.

Order: quality classifier, line dedup, near-duplicate removal, PII surrogates, packing. Each stage takes
(spark, docs, sf_dir); all but the last return the columns of documents. Counts of characters follow the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import line_crf, line_dedup, near_dup, packing, pii
from trailframe.llm.common import checkpoint_folder, read
from trailframe.llm.queries import TOKENIZER, pii_key


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier, fitted on the labelled corpus, rejects."""
    model = line_crf.trained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return line_crf.filtered(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows; documents stay, if need be with an empty text."""
    return recounted(line_dedup.deduplicated(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near_dup.deduplicated(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return recounted(pii.replaced(docs, pii_key(spark)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces into sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def recounted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


STAGES = [("quality classifier", classify), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("pii", replace_pii), ("packing", pack)]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
