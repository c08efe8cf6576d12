"""Streaming forms of the operators: extensions, since recordings come as whole files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import decoded, unnested


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*", **how) -> StreamingQuery:
    """STR-1: decodes each file that appears in a folder and appends its tables as Parquet."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        nested = decoded(batch.select("path", "content"), **how).persist()
        for name, table in unnested(nested).tables().items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        nested.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def dedup(samples: DataFrame, event_time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """STR-2: the first sample of each (activity, channel, time) that arrives within the watermark."""
    return samples.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["activity_id", "channel", event_time])


def recordings(samples: DataFrame, event_time: str = "ts", gap: str = "25 hours", delay: str = "1 hour") -> DataFrame:
    """STR-3: contiguous recordings as sessions: a gap of 25 hours or more begins a new one."""
    return samples.withWatermark(event_time, delay).groupBy("activity_id", F.session_window(event_time, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n"), F.min(event_time).alias("first"), F.max(event_time).alias("last")).select("activity_id", "first", "last", "n")


def downsample(points: DataFrame, step_us: int) -> DataFrame:
    """STR-4: rows (activity_id, seq, time) of a stream, keeping one when a step has passed since the last kept.

    The state is the last kept time of each activity. Within a batch rows are taken in order of time.
    """
    import pandas as pd

    def keep(key, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat([*frames]).sort_values(["time", "seq"])
        kept = []
        for t in rows["time"]:
            take = last is None or t - last >= step_us
            last = t if take else last
            kept.append(take)
        state.update((int(last),))
        yield rows[kept][["activity_id", "seq", "time"]]

    return points.groupBy("activity_id").applyInPandasWithState(keep, "activity_id long, seq long, time long", "last long", "append", "NoTimeout")


def start_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
