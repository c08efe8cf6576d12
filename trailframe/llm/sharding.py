"""Weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a fixed pseudo-random draw u in (0, 1] from the MD5 of its text; the key goes to the shard
of least -ln(u) / weight. A further shard can only win keys for itself, and a shard gets keys in proportion to its
weight. The placement is a row-wise expression: no shuffle, no state, the same on every engine.

Null text has size 1 and the CRC of no bytes; a null key is hashed as the text "null"; repeated keys share a shard.
Equal draws (probability 2**-52) go to the lower shard. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, utf8_size


def draw_score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, with u from 52 bits of the MD5 of "key:shard"."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(2.0**52)) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of each key; shards of weight 0 get nothing."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct(draw_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.least(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"]


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, gapless slot and, for one more shard, the new shard of every document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", (utf8_size(F.col("text")).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * shards).alias("shard"), rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return numbered(checkpointed(rows), ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
