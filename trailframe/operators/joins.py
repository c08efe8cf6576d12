"""Joins along time: nearest sample, exact time, intervals, lookups.

The nearest join puts targets and samples of a recording and channel into one sorted run and carries the last sample seen
from either side, so it is one shuffle on (keys, channel) and linear in the rows, whatever the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import span
from ..model import Activities

DEFAULT_TOLERANCE_US = 5_000_000


def neighbours(targets: DataFrame, samples: DataFrame, keys, sample: Column, target_seq: str = "seq") -> DataFrame:
    """targets (keys, time, target_seq, ...) with _before and _after: the sample struct last before and first at or after."""
    keep = F.struct(*[F.col(c) for c in targets.columns]).alias("_t")
    left = targets.select(*keys, F.col("time").alias("_time"), F.lit(0).alias("_kind"), F.col(target_seq).cast("long").alias("_seq"), keep)
    right = samples.select(*keys, F.col("time").alias("_time"), F.lit(1).alias("_kind"), F.col("seq").cast("long").alias("_seq"), sample.alias("_s"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = Window.partitionBy(*keys)
    past = part.orderBy("_time", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    future = part.orderBy(F.desc("_time"), F.desc("_kind"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_before": F.last("_s", True).over(past), "_after": F.last("_s", True).over(future)})
    return found.where("_kind = 0").select("_t.*", "_before", "_after")


def nearest(targets: DataFrame, samples: DataFrame, keys, tolerance=DEFAULT_TOLERANCE_US, tie: str = "later", how: str = "left", target_seq: str = "seq") -> DataFrame:
    """JN-1, JN-5, JN-6: targets with value, delta (microseconds) and sample_time of the nearest sample within the tolerance.

    keys hold the channel where it matters. tie: "later" takes the sample at or after the target, "earlier" the one before.
    how: "left" keeps unmatched targets with nulls, "inner" drops them.
    """
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(abs(span(tolerance)))
    found = neighbours(targets, samples, keys, F.struct("time", "value"), target_seq)
    d0, d1 = F.col("time") - F.col("_before.time"), F.col("_after.time") - F.col("time")
    first = d0 < d1 if tie == "later" else d0 <= d1
    pick = F.when(F.col("_after").isNull() | first, F.col("_before")).otherwise(F.col("_after"))
    out = found.withColumn("_p", pick).withColumn("delta", F.abs(F.col("_p.time") - F.col("time")))
    fits = F.coalesce(F.col("delta") <= tolerance, F.lit(False))
    out = out.select(*targets.columns, F.when(fits, F.col("_p.value")).alias("value"), F.when(fits, F.col("delta")).alias("delta"), F.when(fits, F.col("_p.time")).alias("sample_time"))
    return out if how == "left" else out.where(F.col("sample_time").isNotNull())


def snapshots(a: Activities, targets: DataFrame, tolerance=DEFAULT_TOLERANCE_US, tie: str = "later") -> DataFrame:
    """JN-1: for each target (keys, seq, time) and each channel of its recording that has a sample near enough: value and delta."""
    channels = a.samples.select(*a.keys, "channel").distinct()
    wanted = targets.select(*a.keys, "seq", "time").join(channels, list(a.keys))
    return nearest(wanted, a.samples, [*a.keys, "channel"], tolerance, tie, "inner")


def pace(speed: Column) -> Column:
    """JN-2: seconds for a kilometre, null unless the speed is positive."""
    return F.when(speed > 0, F.lit(1000.0) / speed)


def wide_snapshots(a: Activities, channels: list[str], tolerance=DEFAULT_TOLERANCE_US, tie: str = "later") -> DataFrame:
    """PRJ-11, PRJ-8: one row for each point with the nearest value and delta of the channels, and the pace."""
    near = snapshots(a.having(samples=a.samples.where(F.col("channel").isin(channels))), a.points, tolerance, tie)
    wide = near.groupBy(*a.keys, "seq").pivot("channel", channels).agg(F.first("value").alias("value"), F.first("delta").alias("delta"))
    out = a.points.join(wide, [*a.keys, "seq"], "left")
    return out.withColumn("pace", pace(F.col("speed_value"))) if "speed" in channels else out


def record_view(a: Activities, channels: list[str]) -> DataFrame:
    """PRJ-8, JN-5: one row for each point with the channels by name and developer fields as a map; ties go to the earlier sample."""
    wide = wide_snapshots(a, channels, tie="earlier")
    from .edit import developer_channels

    dev = snapshots(a.having(samples=developer_channels(a.samples)), a.points, tie="earlier").groupBy(*a.keys, "seq").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "value")))).alias("developer"))
    named = wide.select(*a.points.columns, *[F.col(f"{c}_value").alias(c) for c in channels])
    return named.join(dev, [*a.keys, "seq"], "left")


def last_per_time(samples: DataFrame, keys) -> DataFrame:
    """The last sample of each (keys, channel, time), by pre-aggregation."""
    return samples.groupBy(*keys, "channel", "time").agg(F.max_by("value", "seq").alias("value"))


def exact_time(a: Activities, channels: list[str]) -> DataFrame:
    """JN-3: points with the channels' values at exactly their time."""
    wide = last_per_time(a.samples.where(F.col("channel").isin(channels)), a.keys).groupBy(*a.keys, "time").pivot("channel", channels).agg(F.first("value"))
    return a.points.join(wide, [*a.keys, "time"], "left")


def points_in_laps(a: Activities) -> DataFrame:
    """JN-4: each lap with the points from its start to its end, both included; a point on a border is in both laps."""
    laps = a.laps.select(*a.keys, "lap_no", "start_time", "end_time")
    return a.points.join(laps, list(a.keys)).where(F.col("time").between(F.col("start_time"), F.col("end_time")))


def snapped(a: Activities, retained: DataFrame, tolerance, tie: str = "earlier") -> DataFrame:
    """JN-7: samples whose nearest retained time (keys, time, seq) is within the tolerance; they keep their own time."""
    marks = retained.select(*a.keys, "time", "seq", F.lit(0.0).alias("value"))
    near = nearest(a.samples.withColumnRenamed("value", "_own"), marks, list(a.keys), tolerance, tie, "inner", "seq")
    kept = near.select(*[F.col("_own").alias("value") if c == "value" else F.col(c) for c in a.samples.columns])
    lone = a.samples.join(marks.select(*a.keys).distinct(), list(a.keys), "left_anti")
    return kept.unionByName(lone)


def per_channel_tolerance(a: Activities, targets: DataFrame, tolerances: dict[str, int], default: int = DEFAULT_TOLERANCE_US) -> DataFrame:
    """JN-8: nearest samples with a tolerance (microseconds) for each channel."""
    channels = a.samples.select(*a.keys, "channel").distinct()
    wanted = targets.select(*a.keys, "seq", "time").join(channels, list(a.keys))
    limit = F.coalesce(*[F.when(F.col("channel") == c, F.lit(t)) for c, t in tolerances.items()], F.lit(default)) if tolerances else F.lit(default)
    return nearest(wanted, a.samples, [*a.keys, "channel"], limit, how="inner")
