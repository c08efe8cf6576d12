"""Shared helpers of the corpus operators: table access, checkpoints, Arrow batches, numbering."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailframe.plans.checkpoints import checkpoint_folder, checkpointed
from trailframe.plans.shipping import shipped

#: Rows of an Arrow batch that a function sees at once; Spark bounds the bytes of a batch (arrow.maxBytesPerBatch).
BATCH_ROWS = 512
#: Rows up to which a lookup table may be broadcast; beyond it the callers join by shuffle.
BROADCAST_ROWS = 50_000
#: Rows of one key that go to one task: so many, or this part of all.
KEY_ROWS, KEY_PARTS = 1024, 20_000

__all__ = ["BROADCAST_ROWS", "checkpoint_folder", "checkpointed", "fresh", "joined_by_count", "map_arrow", "numbered", "read", "small_or_shuffled", "spread", "utf8_size", "working_tables"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus folder, by whatever file system Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes a DataFrame once, as a table in the shared folder, and gives the table.

    Unlike a checkpoint, a table is read by column, in splits of the usual size however many tasks wrote it, and its size
    is known to the planner. All tables go at the end, so what leaves the block must be kept by checkpointed().
    """
    folder, number = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}", count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose function sees batches of bounded row count, so that very long texts stay within a worker's memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(shipped(work), schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over the cores if it is a plain scan with fewer partitions than there are, so that one small file is no single task."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search("Join|Aggregate|Window|Sort|Repartition|MapIn|FlatMap|Generate", plan):
        return df  # counting its partitions could run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as the hashed side of a shuffled join; df should be materialized.

    The hashed side spares the other one, mostly texts, a sort.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("shuffle_hash")


def joined_by_count(rows: DataFrame, counted: DataFrame, on: list[str], *by: str) -> DataFrame:
    """rows joined with counted (on, n: the rows of the key, and more; materialized), the rows of hot keys dealt by a hash of the columns by.

    A key is hot when it has more than KEY_ROWS rows and more than one in KEY_PARTS of all; so at most KEY_PARTS keys
    are, which bounds their broadcast, and the part of a key in one task is as small.
    """
    total, largest = counted.agg(F.sum("n"), F.max("n")).first()
    most = max(KEY_ROWS, (total or 0) // KEY_PARTS)
    if (largest or 0) <= most:
        return rows.join(counted.drop("n"), on)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = counted.where(F.col("n") > most).select(*on, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    keys = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(keys, [*on, "_part"]).drop("_part")


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name in columns:
        name += "_"
    return name


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_block: int = 200_000) -> DataFrame:
    """Add out: gapless long numbers from 0 within each group, without a whole group in one task.

    Rows are dealt to blocks by a hash of order (a unique key); a block's start is the running sum of the block
    counts and the rest is numbered inside the block. df is evaluated twice, so it should be materialized.
    """
    blocks = max(16, -(-df.count() // rows_per_block))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    local = dealt.withColumn("_local", F.row_number().over(inside) - 1)
    same = [local[c].eqNullSafe(starts[c]) for c in [*group, "_block"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return local.join(starts, cond, "left").select(*[local[c] for c in df.columns], (starts["_start"] + local["_local"]).cast("long").alias(out))
