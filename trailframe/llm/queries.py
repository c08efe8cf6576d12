"""The queries opN_<name>, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_crf, line_dedup, media, near_dup, packing, pii, quality_rules, sharding, url_filter
from .common import read

#: Tokenizer files by name; a parameter of the operators.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Key of the surrogates; a deployment sets its own in this Spark setting.
PII_KEY_SETTING, PII_DEFAULT_KEY = "spark.trailframe.piiKey", "public test key"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY_SETTING, PII_DEFAULT_KEY).encode()


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, pii_key(spark), "n_entities")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), url_filter.default_blocklist(spark))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_best_fit_packing, op3_minhash_near_dedup, op4_quality_rules, op5_sharding,
    op6_pii_surrogates, op7_line_dedup, op8_byte_bpe, op9_media_columns, op10_url_filters,
)}
ORACLES = {"op4_quality_rules": quality_rules.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op10_url_filters": url_filter.ORACLE}
